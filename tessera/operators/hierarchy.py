"""Walks up the CONTAINS hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fact_tables import Facts
from .neighbours import parents


def owning_modules(facts: Facts, first: bool = False, max_hops: int = 16, include_self: bool = False) -> DataFrame:
    """(id, module): the nearest Module above each node that has one; the node itself only with ``include_self``.

    Unrolled pointer walk: each hop joins the still unresolved nodes with the parent table.
    """
    up = parents(facts, first)
    kinds = facts.nodes.select("id", "kind")
    modules = kinds.where("kind = 'Module'").select(F.col("id").alias("m"))
    walk = kinds.select("id", F.col("id").alias("at"))
    found = walk.join(modules, F.col("at") == F.col("m"), "left_semi").select("id", F.col("at").alias("module")) if include_self else None
    if include_self:
        walk = walk.join(modules, F.col("at") == F.col("m"), "left_anti")
    for _ in range(min(max_hops, 4)):  # module > type > function > field is the deepest nesting
        walk = walk.join(up, F.col("at") == F.col("child")).select("id", F.col("parent").alias("at")).where("at <> id")
        hit = walk.join(modules, F.col("at") == F.col("m"), "left_semi").select("id", F.col("at").alias("module"))
        found = hit if found is None else found.union(hit)
        walk = walk.join(modules, F.col("at") == F.col("m"), "left_anti")
    return found


def area_of_name(name):
    """First two dotted or slashed segments."""
    return F.when(F.contains(name, F.lit("/")), F.substring_index(name, "/", 2)).otherwise(F.substring_index(name, ".", 2))


def zone_of(area):
    """First segment."""
    return F.substring_index(F.substring_index(area, "/", 1), ".", 1)
