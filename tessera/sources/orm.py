"""Mapped classes of Python files as tables: columns, references and data access.

A class is mapped if it writes out a ``__tablename__`` or has a ``Model`` base; its looks
don't count. Files become flat syntax rows; tables, columns, references and accesses are
filters and joins over them, so the order of files is no matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .syntax import scan_syntax

# Names that the two mappers give these things.
RELATIONS = ("ForeignKey", "OneToOneField", "ManyToManyField")
COLUMNS = ("Column", "mapped_column", "relationship")
NO_COLUMNS = ("__tablename__", "__table_args__", "__abstract__", "objects", "Meta")
ACCESS = {"select": "READS", "insert": "WRITES", "update": "WRITES", "delete": "WRITES"}


def scan_orm(files: DataFrame) -> DataFrame:
    return scan_syntax(files)


def mapped(rows: DataFrame) -> DataFrame:
    """(path, scope, class, module, table, django, line): mapped classes by the scope of their bodies."""
    said = lambda name: rows.where((F.col("what") == "set") & (F.col("name") == name) & F.col("first").isNotNull() & (F.col("first") != ""))
    marks = said("__tablename__").groupBy("path", "scope").agg(F.min_by("first", "line").alias("marked"))
    metas = said("db_table").where(F.col("scope").endswith(".Meta")).groupBy("path", F.regexp_replace("scope", r"\.Meta$", "").alias("scope")).agg(F.min_by("first", "line").alias("in_meta"))
    found = rows.where("what = 'class'").select("path", F.col("target").alias("scope"), F.col("name").alias("class"), "module", "line", F.array_contains(F.split("bases", " "), "Model").alias("django"))
    parts = F.split("module", r"\.")
    package = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.col("module"))
    table = F.coalesce("marked", F.when(F.col("django"), F.coalesce("in_meta", F.concat(package, F.lit("_"), F.lower("class")))))
    return found.join(marks, ["path", "scope"], "left").join(metas, ["path", "scope"], "left").withColumn("table", table).where("table IS NOT NULL").drop("marked", "in_meta")


def classes(rows: DataFrame) -> DataFrame:
    """(class, table): of classes with one name, the last by path and line."""
    return mapped(rows).groupBy("class").agg(F.max_by("table", F.struct("path", "line")).alias("table"))


def columns(rows: DataFrame) -> DataFrame:
    """(path, scope, table, django, name, made, line): assignments in a mapped class's body that make a column or a relation."""
    sets = rows.where("what = 'set' AND target IS NOT NULL").where(~F.col("name").isin(*NO_COLUMNS)).select("path", "scope", "name", F.col("holder").alias("made"), "notes", "line")
    own = sets.join(mapped(rows).select("path", "scope", "table", "django"), ["path", "scope"])
    of_mapper = F.col("made").isin(*COLUMNS) | F.array_contains(F.split("notes", " "), "Mapped")
    of_base = F.col("django") & (F.col("made").endswith("Field") | F.col("made").isin(*RELATIONS))
    return own.where(of_mapper | of_base)


def references(rows: DataFrame) -> DataFrame:
    """(owner, table, line): relations written inside a column's assignment; none of a table to itself.

    A name is a class; a string is a class for Model bases and a table's column for the
    other mapper. A class that no file maps gives no row; a written-out table does.
    """
    calls = rows.where((F.col("what") == "call") & F.col("name").isin(*RELATIONS) & F.col("target").isNotNull())
    calls = calls.select("path", "scope", F.col("target").alias("name"), "first", "first_name", F.col("line").alias("at"))
    to = columns(rows).join(calls, ["path", "scope", "name"]).where("first IS NOT NULL OR NOT contains(first_name, '.')")
    by_class = F.when(F.col("first").isNull(), F.col("first_name")).when(F.col("django"), F.substring_index("first", ".", -1))
    asked = to.select(F.col("table").alias("owner"), by_class.alias("class"), F.substring_index("first", ".", 1).alias("written"), "line")
    known = asked.where("class IS NOT NULL").join(classes(rows), "class").select("owner", "table", "line")
    return known.unionByName(asked.where("class IS NULL").select("owner", F.col("written").alias("table"), "line")).where("owner <> table")


def accesses(rows: DataFrame) -> DataFrame:
    """(scope, table, kind, line): statements on a mapped class inside functions."""
    kind = F.coalesce(*[F.when(F.col("name") == n, F.lit(k)) for n, k in ACCESS.items()])
    calls = rows.where("what = 'call' AND inside IS NOT NULL AND NOT contains(first_name, '.')").select("scope", F.col("first_name").alias("class"), kind.alias("kind"), "line").where("kind IS NOT NULL")
    return calls.join(classes(rows), "class").select("scope", "table", "kind", "line")


def data_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, kind, line): module to table and table to column (CONTAINS), REFERENCES, READS and WRITES."""
    entity = lambda *c: F.concat(F.lit("py:entity:"), F.concat_ws(".", *c))
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), kind.alias("kind"), "line")
    contains = F.lit("CONTAINS")
    out = edge(mapped(rows), F.concat(F.lit("py:"), "module"), entity("table"), contains)
    out = out.unionByName(edge(columns(rows).where("made <> 'relationship'"), entity("table"), entity("table", "name"), contains))
    out = out.unionByName(edge(references(rows), entity("owner"), entity("table"), F.lit("REFERENCES")))
    return out.unionByName(edge(accesses(rows), F.concat(F.lit("py:"), "scope"), entity("table"), F.col("kind")))
