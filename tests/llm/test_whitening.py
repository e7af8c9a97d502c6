from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.whitening import fit_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>"


def made(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("id", "v", "whitened", "deviation", "n")}).repartition(3)


def brute(rows, k=32):
    """Exact covariance of the grid vectors by fractions, and its eigenvectors by numpy."""
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = (np.array(y, float) / n) @ vectors / np.sqrt(values)
    return n, [sum(v * v for v in r) for r in y], values, vectors, white, values / np.trace(cov)


def compare(spark, rows, k=32, **how):
    df = made(spark, rows)
    model = fit_whitening(df, components=k, **how)
    n, deviation, values, vectors, white, explained = brute(rows, k)
    assert model.n == n and model.identity_error < 1e-9
    np.testing.assert_allclose(model.variances, values, rtol=1e-10)
    np.testing.assert_allclose(model.explained, explained, rtol=1e-10)
    signs = np.sign((model.components * vectors).sum(axis=0))
    np.testing.assert_allclose(model.components * signs, vectors, atol=1e-9)
    got = {r.vec_id: r for r in whiten(df, model).collect()}
    assert {i: r.deviation for i, r in got.items()} == {i: v for (i, _), v in zip(rows, deviation, strict=True)}
    np.testing.assert_allclose(np.array([got[i].whitened for i, _ in rows]) * signs, white, atol=1e-7)
    return model


def vectors(n, d, fall, seed=3):
    rnd = np.random.default_rng(seed)
    turned = np.linalg.qr(rnd.standard_normal((d, d)))[0]
    x = rnd.standard_normal((n, d)) * (8 * fall ** np.arange(d)) @ turned + rnd.standard_normal(d)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_flat_spectrum_expands(spark):
    model = compare(spark, vectors(400, 20, 0.97), k=6, oversampling=3)
    assert model.expanded


def test_steep_spectrum_needs_no_expansion(spark):
    """Little variance lies outside of the block, so a few power passes reach double precision."""
    rows = [(i, [64 * c if j < 4 else c / 64 for j, c in enumerate(v)]) for i, v in enumerate(np.random.default_rng(1).standard_normal((300, 12)).tolist())]
    rows = [(i, [c * 1.5**j for j, c in enumerate(v)]) for i, v in rows]
    model = compare(spark, rows, k=2, oversampling=4)
    assert not model.expanded and model.passes <= 9


def test_fewer_dimensions_than_components(spark):
    model = compare(spark, vectors(50, 5, 0.8))
    assert model.components.shape == (5, 5) and not model.expanded


def test_unusable_rows_are_left_out(spark):
    good = vectors(60, 6, 0.8)
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, [1.0]), (105, []), (106, [3e38] * 6)]
    df, plain = made(spark, good + odd), made(spark, good)
    model, alone = fit_whitening(df), fit_whitening(plain)
    assert model.n == 60 and model.sums == alone.sums
    np.testing.assert_allclose(model.variances, alone.variances)
    assert {r.vec_id for r in whiten(df, model).collect()} == set(range(60))


def test_rank_null_ids_and_copies(spark):
    """A dimension that repeats another has no variance of its own; equal rows and null ids are rows."""
    rows = [(None if i % 7 == 0 else i % 20, [*v, v[0]]) for i, v in vectors(80, 4, 0.8)]
    df = made(spark, rows)
    model = fit_whitening(df)
    assert model.components.shape == (5, 4) and model.identity_error < 1e-9
    assert whiten(df, model).count() == 80


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    df = made(spark, rows)
    model = fit_whitening(df)
    assert model.components.shape[1] == 0
    assert [r.whitened for r in whiten(df, model).collect()] == [[] for v in rows if v[1] is not None]


def test_large_entries_stay_exact(spark):
    rows = [(1, [2.0**50, 1.0]), (2, [0.0, 2.0]), (3, [1.0, -5.0])]
    df = made(spark, rows, "vec_id long, embedding array<double>")
    model = fit_whitening(df)
    assert model.sums == [2**56 + 64 + 3_000_000, -128 + 3_000_000]
    assert {r.deviation for r in whiten(df, model).collect()} == {None}
