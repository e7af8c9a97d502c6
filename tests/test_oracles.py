"""Every query with an oracle against DuckDB on the smallest tables, and properties of the others."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return round(float(v), 6)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_is_stable(spark, name):
    first, again = QUERIES[name](spark, SF), QUERIES[name](spark, SF)
    assert rows(first.columns, first.collect()) == rows(again.columns, again.collect())
    assert first.columns


def test_shuffle_partitions_do_not_matter(spark):
    some = ["d06_hotspots", "g01_impact_of", "j17_enclosing_symbol", "d40_runs"]
    before = {n: rows(QUERIES[n](spark, SF).columns, QUERIES[n](spark, SF).collect()) for n in some}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert before == {n: rows(QUERIES[n](spark, SF).columns, QUERIES[n](spark, SF).collect()) for n in some}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edge_kind_filter_prunes_other_tables(spark):
    from tessera.sources.fact_tables import facts

    plan = facts(spark, SF).edges.where(F.col("kind") == "IMPLEMENTS")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_names_of_the_flagship_tables():
    assert {os.path.basename(p).split(".")[0] for p in glob.glob(f"{SF}/*.parquet")} == set(TABLES)
