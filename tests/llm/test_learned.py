"""Compression classifier and language identification."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.compression_classifier import compression_scores, fit_compression_model
from tessera.llm.language_id import fit_language_model, identify_languages

from .fixtures import frame, words


def corpus():
    good = [(k, words(k, 150, "word")) for k in range(120)]
    bad = [(1_000 + k, " ".join(f"{w}!!###" for w in words(k, 150, "X").upper().split())) for k in range(80)]
    return good, bad


def test_classifier_separates_held_out_text(spark):
    good, bad = corpus()
    docs = frame(spark, good + bad)
    train = [(i, 1, 0) for i, _ in good[:80]] + [(i, 0, 0) for i, _ in bad[:50]]
    model = fit_compression_model(docs, spark.createDataFrame(train, "doc_id long, quality int, toxic int"))
    scores = {r.doc_id: (r.score, r.predicted) for r in compression_scores(docs, model).collect()}
    assert np.mean([scores[i][1] == 1 for i, _ in good[80:]]) > 0.95
    assert np.mean([scores[i][1] == 0 for i, _ in bad[50:]]) > 0.95
    assert all(0 <= s <= 1 for s, _ in scores.values())


def test_classifier_edges(spark):
    docs = frame(spark, [(1, None), (1, ""), (None, "x"), (4, "y" * 300_000)])
    one_class = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = fit_compression_model(docs, one_class)
    assert model is None
    assert [(r.score, r.predicted) for r in compression_scores(docs, model).collect()] == [(0.5, 0)] * 4
    tiny = spark.createDataFrame([(4, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    fit_compression_model(docs, tiny)
    assert compression_scores(frame(spark, []), None).count() == 0
    good, bad = corpus()
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    model = fit_compression_model(frame(spark, good + bad), labels)
    out = compression_scores(docs, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)


def languages():
    stems = {"aa": "ka lo mi", "bb": "tü rö ßa", "cc": "ñe que llo"}
    rows, k = [], 0
    for lang, parts in stems.items():
        p = parts.split()
        for n in range(40):
            rng = np.random.default_rng(k)
            rows.append((k, " ".join("".join(rng.choice(p, rng.integers(1, 4))) for _ in range(40)), lang))
            k += 1
    return rows


def test_languages_of_held_out_and_unseen_words(spark):
    rows = languages()
    docs = frame(spark, rows)
    model = fit_language_model(docs, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    odd = [(1, "kalomikalomi"), (2, "TÜRÖ"), (3, None), (4, "123 ... !"), (5, ""), (None, "quello"), (5, "quello"), (7, "kalo " * 50_000)]
    got = [(r.doc_id, r.lang_pred) for r in identify_languages(frame(spark, odd), model).collect()]
    assert got == [(1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (None, "cc"), (5, "cc"), (7, "aa")]


def test_languages_without_training(spark):
    docs = frame(spark, [(1, "abc", None), (2, None, "aa")])
    model = fit_language_model(docs, F.lit(True))
    assert [(r.lang_pred, r.score) for r in identify_languages(docs, model).collect()] == [("und", 0.0)] * 2
    assert identify_languages(frame(spark, []), model).count() == 0


def test_memory_of_words_is_bounded(spark):
    from tessera.llm.language_id import _Scorer

    model = fit_language_model(frame(spark, languages()), F.lit(True))
    text = [f"kalo{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    small, large = _Scorer(model, memory_bytes=1), _Scorer(model)
    assert np.allclose(small.of(text), large.of(text))
