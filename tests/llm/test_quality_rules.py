import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm.quality_rules import log_ratios, quality_rules

from .fixtures import frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), base


TEXTS = [
    None, "", "   \n\t ", "one", "a b c", "a b c a b c", "a b c d a b c", "x " * 200, words(1, 300), words(2, 49), words(3, 50),
    "l1\nl2\nl1\n\n \nl1", "ü😀 <|#\x0b&% z", "a b c " * 9 + words(4, 60), words(5, 20_000), (words(6, 30) + "\n") * 3,
]


def test_measures(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, words(1, 300)), (3, "one")]
    got = quality_rules(frame(spark, rows), spark.createDataFrame([(8,), (10,)], "doc_id long")).select(
        "doc_id", "text", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed"
    )
    assert got.count() == len(rows)
    for r in got.collect():
        assert tuple(r)[2:] == brute(r.text), r.doc_id


def test_ratio_keeps_clean_and_drops_marked_text(spark):
    clean = [(i, words(i, 120)) for i in range(60)]
    junk = [(100 + i, " ".join(f"{w}***" for w in words(i, 120).split())) for i in range(15)]
    got = quality_rules(frame(spark, clean + junk), spark.createDataFrame([(i,) for i in range(30)], "doc_id long"))
    kept = {r.doc_id for r in got.where("quality.kept").select("doc_id").collect()}
    assert kept == {i for i, _ in clean}


def test_no_target_and_no_rows(spark):
    nobody = spark.createDataFrame([], "doc_id long")
    got = quality_rules(frame(spark, [(1, words(1, 80)), (2, None)]), nobody).select("doc_id", "quality.kept", "quality.llr").collect()
    assert {(r.doc_id, r.kept, r.llr) for r in got} == {(1, True, 0.0), (2, False, 0.0)}
    assert quality_rules(frame(spark, []), nobody).count() == 0


def test_ratios_are_counts(spark):
    docs = frame(spark, [(1, "a a b"), (2, "c")])
    ratios = log_ratios(docs.select("doc_id", "text"), F.col("doc_id") == 1, "text", 64)
    assert len(ratios) == 64 and max(ratios) > 0 > min(ratios)


def plain_buckets(text, buckets):
    """Buckets of tokens and of neighbours, hashed by the xxhash library with Spark's seed."""
    import struct

    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hashes = [signed(xxhash.xxh64(t.encode(), seed=42).intdigest()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    long = lambda x, seed: xxhash.xxh64(struct.pack("<q", x), seed=seed & (1 << 64) - 1).intdigest()
    pairs = [signed(long(b, long(a, 42))) for a, b in zip(hashes, hashes[1:])]
    return [h % buckets for h in hashes + pairs]


@pytest.mark.parametrize("buckets", [16, 5_000])
def test_ratios_by_brute_force(spark, buckets):
    """llr and kept of every text are those of plain counts over all texts."""
    import math

    texts = [words(k, 70 + k, "w" if k % 3 else "v") for k in range(24)] + ["a***b###c " * 30, "", None, "one", words(2, 70)]
    rows = list(enumerate(texts))
    trusted = {k for k, _ in rows if k % 4 == 0}
    raw, target, of = Counter(), Counter(), {}
    for k, text in rows:
        of[k] = plain_buckets(text, buckets)
        raw.update(of[k])
        target.update(of[k] if k in trusted else [])
    share = sum(target.values()) / sum(raw.values())
    lift = {b: (target[b] + 5) / (raw[b] * share + 5) for b in raw}
    whole = sum(raw[b] * lift[b] for b in raw) / sum(raw.values())
    want = {k: sum(math.log(lift[b] / whole) for b in of[k]) / len(of[k]) if of[k] else 0.0 for k in of}
    got = quality_rules(frame(spark, rows), spark.createDataFrame([(k,) for k in trusted], "doc_id long"), buckets=buckets).select("doc_id", "quality.*").collect()
    for r in got:
        assert r.llr == pytest.approx(want[r.doc_id], abs=1e-9), r.doc_id
        assert r.kept == (not r.base_failed and want[r.doc_id] >= -0.25)


def test_no_python_in_the_plan(spark):
    plan = quality_rules(frame(spark, [(1, "a")]), spark.createDataFrame([(1,)], "doc_id long"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
