"""Calls and bases of Python files, resolved by joins over their syntax rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scopes import nearest_binding, python_targets

#: The columns of syntax rows that are read here.
USED = ["path", "module", "what", "name", "holder", "target", "block", "owner", "caller", "form", "line", "chain"]


def _id(column: str) -> F.Column:
    return F.concat(F.lit("py:"), column)


def bindings(rows: DataFrame) -> DataFrame:
    """(file, scope, name, what, target) of every import, definition, parameter and local."""
    what = F.when(F.col("what") == "bind", F.col("holder")).otherwise(F.col("what"))
    target = F.when(F.col("what") == "import", _id("holder")).when(F.col("what").isin("function", "class"), _id("target"))
    return rows.where("what IN ('import', 'function', 'class', 'bind')").select(F.col("path").alias("file"), F.col("block").alias("scope"), "name", what.alias("what"), target.alias("target"))


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    binds = bindings(rows)
    modules = rows.select(F.col("path").alias("file"), F.col("module").alias("scope")).distinct().withColumn("top", F.lit(True))
    known = binds.where("what IN ('import', 'function', 'class')").select("file", "scope", "name").distinct().withColumn("held", F.lit(True))
    marked = binds.join(modules, ["file", "scope"], "left").join(known, ["file", "scope", "name"], "left")
    binds = marked.where("what <> 'local' OR top IS NULL OR held IS NULL").select("file", "scope", "name", "what", "target")
    methods = rows.where("what = 'function' AND owner = block").select(_id("owner").alias("owner"), "name")
    return binds, methods


def resolved_calls(rows: DataFrame) -> DataFrame:
    """(src, dst, line) of the calls in ``rows`` (see ``syntax.scan_syntax``) whose target is certain.

    In a module an import or a definition holds whatever else is assigned to its name; in a
    function a parameter or an assignment hides it. What nested functions call, the outermost
    one calls.
    """
    binds, methods = _blocks(rows)
    calls = rows.where("what = 'call' AND caller IS NOT NULL AND (form = 'name' OR holder IS NOT NULL)").select(
        F.col("path").alias("file"), _id("caller").alias("caller"), _id("owner").alias("owner"), "holder", "name", "line", F.split("chain", " ").alias("chain")
    )
    found = python_targets(calls, binds, methods)
    return found.select(F.col("caller").alias("src"), F.col("target").alias("dst"), "line")


def resolved_bases(rows: DataFrame) -> DataFrame:
    """(src, dst, line, external) of the bare bases in ``rows``; a base that nothing here defines is an external type."""
    binds, _ = _blocks(rows)
    bases = rows.where("what = 'base'").select(F.col("path").alias("file"), _id("target").alias("src"), "name", "line", F.split("chain", " ").alias("chain"))
    found = nearest_binding(bases, binds, prefer=("import", "function", "class"))
    return found.select("src", F.coalesce("bound.target", _id("name")).alias("dst"), "line", F.col("bound.target").isNull().alias("external"))
