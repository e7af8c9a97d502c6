"""Ordered trees: nodes numbered in reading order, and nested JSON built from flat rows.

Reading order comes from an Euler tour. Every node is entered and left; what follows each
such event is known from the node's first child, next sibling and parent, so a tour is a
linked list, and a list is ranked by pointer jumping: the number of rounds grows with the
logarithm of a tree's size, however deep it is, and no row grows with the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .traversal import write_once


def reading_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, id, parent, rank, ...) with ``place`` (from 0, over the whole tree) and ``depth`` (from 0).

    ``parent`` is null at a root; a tree may have several, in order of rank. Siblings stand by
    rank, then id. Nodes below a parent that isn't there, or on a cycle, are reached from no
    root and get nulls. A node's children are ordered in one group, rows of a few numbers.
    """
    kin = Window.partitionBy("tree", "parent").orderBy("rank", "id")
    rows = nodes.select("tree", "id", "parent", "rank").withColumn("next", F.lead("id").over(kin))
    eldest = rows.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("id")).agg(F.min_by("id", F.struct("rank", "id")).alias("child"))
    rows = rows.join(eldest, ["tree", "id"], "left")
    event = lambda node, leaving: F.struct(node.alias("id"), F.lit(leaving).alias("leaving"))
    enter = rows.select("tree", event(F.col("id"), False).alias("at"), F.when(F.col("child").isNotNull(), event(F.col("child"), False)).otherwise(event(F.col("id"), True)).alias("to"), F.lit(1).alias("entered"), F.lit(1).alias("down"), F.lit(False).alias("ends"))
    leave = rows.select("tree", event(F.col("id"), True).alias("at"), F.when(F.col("next").isNotNull(), event(F.col("next"), False)).when(F.col("parent").isNotNull(), event(F.col("parent"), True)).alias("to"), F.lit(0).alias("entered"), F.lit(-1).alias("down"), (F.col("next").isNull() & F.col("parent").isNull()).alias("ends"))
    # entered and down: sums over the part of the list from here to just before ``to``
    tour = write_once(enter.unionByName(leave))
    before, still = None, tour.where("to IS NOT NULL").count()
    while still and still != before:  # each round ends the lists of up to twice the length; those on a cycle never end
        ahead = tour.select("tree", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("entered").alias("_e"), F.col("down").alias("_d"), F.col("ends").alias("_ends"))
        tour = write_once(
            tour.join(ahead, ["tree", "to"], "left").select(
                "tree", "at", F.col("_to").alias("to"), (F.col("entered") + F.coalesce("_e", F.lit(0))).alias("entered"), (F.col("down") + F.coalesce("_d", F.lit(0))).alias("down"), F.coalesce("_ends", "ends").alias("ends")
            )
        )
        before, still = still, tour.where("to IS NOT NULL").count()
    entered = tour.where("NOT at.leaving AND to IS NULL AND ends").select("tree", F.col("at.id").alias("id"), "entered", "down")
    size = entered.groupBy("tree").agg(F.max("entered").alias("_n"))
    numbered = entered.join(size, "tree").select("tree", "id", (F.col("_n") - F.col("entered")).alias("place"), (-F.col("down")).alias("depth"))
    return nodes.join(numbered, ["tree", "id"], "left")


def flat_text(nodes: DataFrame, text: str = "text") -> DataFrame:
    """(tree, text, blocks, deepest): the texts of a tree's nodes in reading order, a line each; those that no root reaches are left out."""
    rows = reading_order(nodes).where("place IS NOT NULL")
    whole = rows.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("place", text))).alias("b"), F.max("depth").alias("deepest"))
    return whole.select("tree", F.array_join(F.transform("b", lambda x: F.coalesce(x[text], F.lit(""))), "\n").alias("text"), F.size("b").alias("blocks"), "deepest")


def nested_json(nodes: DataFrame) -> DataFrame:
    """(tree, json): each tree's JSON, put together from the leaves up, a level a round.

    ``nodes`` (tree, id, parent, depth, rank, head, tail): a node is written as its head, its
    children by rank with commas between them, and its tail; depth is 0 at the one root. There
    are as many rounds as the deepest node has ancestors, over the rows of one level each.
    """
    rows = write_once(nodes.select("tree", "id", "parent", "depth", "rank", "head", "tail"))
    deepest = rows.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(deepest or 0, -1, -1):
        level = rows.where(F.col("depth") == depth)
        inner = F.lit("")
        if below is not None:
            held = below.groupBy("tree", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "json"))).alias("c"))
            level = level.join(held, ["tree", "id"], "left")
            inner = F.coalesce(F.array_join(F.transform("c", lambda x: x["json"]), ","), F.lit(""))
        below = level.select("tree", "parent", "rank", F.concat("head", inner, "tail").alias("json"))
        if depth:
            below = write_once(below)
    return below.select("tree", "json")
