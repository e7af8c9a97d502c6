"""Names resolved by ordered rules; the first rule that answers holds, and ambiguity is no answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_types(refs: DataFrame, types: DataFrame, imports: DataFrame, unique_simple: bool = False) -> DataFrame:
    """``refs`` (package, file, name) with ``type``, the qualified name or null.

    ``types`` (package, name); ``imports`` (file, name, target). In order: a name with a dot
    is taken as it is, an import of the file, a type of the same package, and, with
    ``unique_simple``, the only type of that name anywhere. One row in, one row out: each
    rule's table has one row a key.
    """
    imported = imports.groupBy("file", "name").agg(F.min("target").alias("_i"), F.max("target").alias("_j"))
    imported = imported.where("_i = _j").drop("_j")
    local = types.select("package", "name").distinct().withColumn("_l", F.concat_ws(".", "package", "name"))
    rules = [F.when(F.col("name").contains("."), F.col("name")), F.col("_i"), F.col("_l")]
    out = refs.join(imported, ["file", "name"], "left").join(local, ["package", "name"], "left")
    if unique_simple:
        only = local.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("_l").alias("_u")).where("_n = 1").drop("_n")
        out = out.join(only, "name", "left")
        rules.append(F.col("_u"))
    return out.select(*refs.columns, F.coalesce(*rules).alias("type"))


def package_placeholders(targets: DataFrame) -> DataFrame:
    """External nodes (id, kind, name) for ``targets`` (id) keyed by a package, ``lang:package:name``: the function and its module, once each.

    Targets in the repository have one colon and need none.
    """
    keyed = targets.where(F.regexp_count("id", F.lit(":")) >= 2).select("id").distinct()
    name = F.substring_index("id", ":", -1)
    module = F.regexp_replace("id", r":[^:]*$", "")
    functions = keyed.select("id", F.lit("Function").alias("kind"), name.alias("name"))
    modules = keyed.select(module.alias("id")).distinct().select("id", F.lit("Module").alias("kind"), F.regexp_replace("id", r"^[^:]*:", "").alias("name"))
    return functions.unionByName(modules)


def _flat(path):
    """A path without ``.`` and ``..``; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(
        parts,
        F.array(F.lit("")),  # the root; a step above it leaves nothing, and then everything is null
        lambda kept, p: F.when(p == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1))).otherwise(F.concat(kept, F.array(p))),
    )
    return F.array_join(F.slice(up, 2, F.greatest(F.size(up) - 1, F.lit(0))), "/")


def unique_basenames(files: DataFrame) -> DataFrame:
    """(base, file) of ``files`` (file): base names that one file only has."""
    base = F.substring_index("file", "/", -1)
    return files.select("file").distinct().groupBy(base.alias("base")).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).where("n = 1").drop("n")


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """``includes`` (file, include) with ``target``: the file that is meant, or null.

    In order: beside the including file, from the root, and the only header of that base name.
    """
    folder = F.regexp_replace("file", r"[^/]*$", "")
    known = files.select(F.col("file").alias("_k")).distinct()
    asked = includes.withColumns({"_a": _flat(F.concat(folder, "include")), "_b": _flat(F.col("include")), "_base": F.substring_index("include", "/", -1)})
    headers = unique_basenames(files.where(F.col("file").endswith(".h"))).select(F.col("base").alias("_base"), F.col("file").alias("_c"))
    out = asked.join(known.select(F.col("_k").alias("_a"), F.col("_k").alias("_near")), "_a", "left")
    out = out.join(known.select(F.col("_k").alias("_b"), F.col("_k").alias("_top")), "_b", "left").join(headers, "_base", "left")
    return out.select(*includes.columns, F.coalesce("_near", "_top", "_c").alias("target"))
