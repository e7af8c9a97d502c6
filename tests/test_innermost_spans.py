"""Spots in the smallest of many spans, against brute force."""

import random

from tessera.operators.neighbours import innermost_spans


def test_the_smallest_span_of_many_holds(spark):
    rnd = random.Random(11)
    spans = [(rnd.choice("ab"), a := rnd.randrange(-40, 300), a + rnd.choice((0, 1, 2, 7, 30, 200, 1 << 40)), rnd.randrange(50), f"s{k}") for k in range(400)]
    spans += [("a", 5, None, 1, "open"), ("a", None, 9, 1, "unknown"), ("a", 9, 5, 1, "empty"), (None, 1, 9, 1, "nowhere")]
    spots = [(f, n) for f in ("a", "b", "c", None) for n in (*range(-50, 320), 1 << 39, None)]
    got = innermost_spans(spark.createDataFrame(spots * 2, "file string, line long"), spark.createDataFrame(spans, "file string, first long, last long, seq long, id string"))
    want = {}
    for f, n in spots:
        held = [(last - first, seq, i) for file, first, last, seq, i in spans if None not in (n, f, first, last) and file == f and first <= n <= last]
        if held:
            want[f, n] = min(held)
    assert len(want) > 400 and {(r.file, r.line): tuple(r.best) for r in got.collect()} == want


def test_a_file_of_many_spans_makes_few_rows(spark):
    """50,000 spots and as many spans of one file: 2.5 billion pairs, but rows by the logarithm of a span's length."""
    spots = spark.range(50_000).selectExpr("'f' AS file", "id AS line")
    got = innermost_spans(spots, spots.selectExpr("file", "line AS first", "line + 1000 AS last", "line AS seq", "CAST(line AS STRING) AS id"))
    assert got.where("best.seq = greatest(line - 1000, 0)").count() == 50_000


def test_only_callers_of_faulty_symbols_are_counted(spark):
    from tessera.plans.registry import QUERIES

    got = QUERIES["j38_localize"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and got.count()
    assert "event_type" not in plan  # the traces are read as they were written, not made once more
