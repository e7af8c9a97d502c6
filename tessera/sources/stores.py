"""Page trees, blame text, catalogs and saved facts as sources."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traversal
from .exports import load, save
from .fact_tables import Facts


def fetch_tree(children: DataFrame, root: str, max_depth: int, max_docs: int) -> DataFrame:
    """(id, depth, truncated): pages below ``root``, breadth first, ties by id.

    ``children``: (parent, id). The first ``max_docs`` pages are given, which is what the
    limit is for, and ``truncated`` says on each row whether there were more. A page that is
    reached twice counts once, at its least depth.
    """
    start = children.sparkSession.createDataFrame([(root,)], "id string")
    hops = children.select(F.col("parent").alias("a"), F.col("id").alias("b"))
    below = traversal.reach(start, hops, max_depth).where(F.col("node") != root).select(F.col("node").alias("id"), F.col("hop").alias("depth"))
    pages = start.withColumn("depth", F.lit(0)).unionByName(below)
    total = pages.agg((F.count(F.lit(1)) > max_docs).alias("truncated"))  # one row
    return pages.orderBy("depth", "id").limit(max_docs).join(total)


def blame_lines(porcelain: Column) -> Column:
    """Array of (line, sha) from the line-by-line text that ``git blame --line-porcelain`` prints."""
    head = r"(?m)^([0-9a-f]{40}) \d+ (\d+)"
    shas, lines = F.regexp_extract_all(porcelain, F.lit(head), F.lit(1)), F.regexp_extract_all(porcelain, F.lit(head), F.lit(2))
    return F.transform(F.arrays_zip(shas.alias("sha"), lines.alias("line")), lambda x: F.struct(x["line"].cast("long").alias("line"), x["sha"].alias("sha")))


def describe_tables(spark: SparkSession, database: str) -> list[tuple[str, bool, str, str, bool]]:
    """(table, is_view, column, type, nullable) of a database's tables, by name and column order."""
    found = []
    for t in sorted((t for t in spark.catalog.listTables(database) if t.namespace), key=lambda t: t.name):
        found += [(t.name, t.tableType == "VIEW", c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(f"{database}.{t.name}")]
    return found


def try_ddl(spark: SparkSession, statements: list[str]) -> tuple[int, str, list[tuple]]:
    """Statements tried in order in a database of their own: how many went through, the first error, and the tables they left.

    ``{db}`` in a statement stands for that database. It is dropped at the end, whatever happens.
    """
    database = f"trial_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    done, error = 0, ""
    try:
        for s in statements:
            try:
                spark.sql(s.format(db=database))
            except Exception as e:  # the error is the answer
                error = str(e).splitlines()[0]
                break
            done += 1
        return done, error, describe_tables(spark, database)
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def load_or_build(spark: SparkSession, folder: str, commit: str | None, fingerprint: str, build: Callable[[], Facts]) -> tuple[Facts, bool]:
    """Facts saved for this commit and extractor, and whether they were there; without a commit nothing is kept.

    A save that didn't finish has no mark and is made anew; facts of another format version are built anew.
    """
    if commit is None:
        return build(), False
    path = f"{folder.rstrip('/')}/{commit}/{fingerprint}"
    jvm = spark.sparkContext._jvm
    marks = [jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/_SUCCESS") for part in ("nodes", "edges")]
    files = marks[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if all(files.exists(m) for m in marks):
        try:
            return load(spark, path), True
        except ValueError:
            pass
    save(build(), path)
    return load(spark, path), False


def filled_columns(df: DataFrame) -> DataFrame:
    """(c, filled): each column of a table, and how many of its rows hold a value."""
    return df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).unpivot([], df.columns, "c", "filled")
