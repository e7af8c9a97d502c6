"""Queries on rows that the given tables lack or have few of, against their own SQL."""

import random

import pytest

from tessera.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture
def same(spark, tmp_path):
    """Writes named tables, runs a query and its SQL on them, and returns both results, sorted."""

    def run(name, **tables):
        duck = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{table}.parquet"))
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = QUERIES[name](spark, str(tmp_path))
        return sorted(map(tuple, got.collect()), key=str), sorted(duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall(), key=str)

    return run


def test_an_artifact_is_one_line_whatever_its_length(same):
    got, want = same("s53_artifact", pages=([(k, "https://x.example/" + "ü/" * k) for k in (0, 18, 19, 20, 40, 400)] + [(500, ""), (501, None)], "page_id long, url string"))
    assert got == want and not any("\n" in (r[1] or "") for r in got)


def test_markdown_of_every_kind_comes_back(same):
    rnd = random.Random(5)
    bits = ["# ", "##  ", "- ", "* ", "+  ", "3. ", "12) ", "> ", ">", "| ", " | ", "|", "||", "---", "--|--", "| -- | :--: |", "***", "```", "~~~ py", "`a`", "**b c**", "**", "*", "`", "[l](t)", "[](t)", "[**l](t)", "https://a.b/**c**", " ", "  ", "\t", "\r", "\x0b", "\xa0", "\x1c", "a", "b c", "ü", "|a|b|c|"]
    texts = ["", " \n\t\n", "3. first word a number", "x\r\ny\rz\r\n", "> a\n>\n> > b\n> ```\n>\n> c\n", "a|b\n--|--\n1|2|3\n4\n|5|\n", "- a\n  - b\n1. c\n\n- d", "```\n `x` \n\n**y**", "[a](b) [](c) https://d.e", None]
    texts += ["\n".join("".join(rnd.choice(bits) for _ in range(rnd.randrange(5))) for _ in range(rnd.randrange(1, 12))) for _ in range(600)]
    got, want = same("x25b_round_trip", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert [x for x in got if x not in want][:5] == [] and got == want


def test_containment_of_random_sets(same):
    """Frequent elements, sets of one element, copies of rows, and nulls in every column."""
    rnd = random.Random(3)
    some = lambda n: rnd.choice((None, *range(n))) if rnd.random() < 0.1 else int(n * rnd.random() ** 3)
    lines = [(some(150), some(40), some(60)) for _ in range(900)]
    lines += [(1_000, 0, None), (1_001, None, 5), (1_002, 700, 5), (1_002, 700, 6), (None, 700, 7)]
    got, want = same("j34_set_containment", lineitem=(lines, "l_orderkey long, l_partkey long, l_suppkey long"))
    assert len(want) > 200 and got == want and any(r[1] is None for r in got)


def test_few_pairs_are_made_that_do_not_hold(spark):
    """Each of 300 sets has two elements of 64 large sets each that share one: 19,200 pairs by the rarest element, few by all signatures."""
    from pyspark.sql import functions as F

    from tessera.operators.links import containment_join

    small = spark.range(300).select(F.col("id").alias("s"), F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("e"))
    large = spark.range(600).select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("n"), F.col("id").alias("e"))
    large = large.select(F.when(F.col("n") == 0, F.floor(F.col("e") / 2)).otherwise(F.col("e") * 100 + F.col("n") + 10_000).alias("l"), "e")
    got = containment_join(small, large, "s", "l", "e")
    assert sorted(map(tuple, got.collect())) == [(k, k) for k in range(300)]
    assert "bit_and" in got._jdf.queryExecution().optimizedPlan().toString()
