"""Communities of weighted undirected graphs by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import traversal as T


def levels(hops: DataFrame) -> DataFrame:
    """(node, level): the length of the longest chain of ever larger neighbours that ends in a node.

    Neighbours never share a level. Each round takes the nodes whose smaller neighbours all have theirs, so
    there are as many rounds as levels.
    """
    spark = hops.sparkSession
    path, level = T.scratch(spark, "levels"), 0
    rising = T.write_once(hops.where("a < b").select("a", "b").distinct())
    waiting = T.write_once(hops.select(F.col("a").alias("node")).distinct())
    while not waiting.isEmpty():
        ready = T.write_once(waiting.join(rising.select(F.col("b").alias("node")), "node", "left_anti"))
        ready.withColumn("level", F.lit(level).cast("long")).write.mode("append").parquet(path)
        still = T.write_once(waiting.join(ready, "node", "left_anti"))
        onward = T.write_once(rising.join(ready.select(F.col("node").alias("a")), "a", "left_anti"))
        T.drop_saved(waiting, ready, rising)
        waiting, rising, level = still, onward, level + 1
    return spark.read.schema("node string, level long").parquet(path) if level else waiting.withColumn("level", F.lit(0).cast("long"))


def by_turns(hops: DataFrame, max_passes: int) -> DataFrame:
    """(node, first) of components of any size: the visits of one pass and level don't depend on each other, so they are one join and two aggregates.

    A node is visited again only if a neighbour has moved since, in the same pass if that neighbour is of a lower
    level; what no neighbour changes would keep its label.
    """
    level = levels(hops)
    hops = T.write_once(
        hops.join(level.select(F.col("node").alias("a"), F.col("level").alias("la")), "a").join(level.select(F.col("node").alias("b"), F.col("level").alias("lb")), "b")
    )
    span = (level.agg(F.max("level")).first()[0] or 0) + 1
    label = T.write_once(level.select("node", F.col("node").alias("label")))
    due = T.write_once(level.select("node", F.col("level").alias("turn")))
    while (turn := due.agg(F.min("turn")).first()[0]) is not None and turn < max_passes * span:
        visited = due.where(F.col("turn") == turn).select(F.col("node").alias("a"))
        near = hops.join(visited, "a", "left_semi").join(label.select(F.col("node").alias("b"), "label"), "b")
        votes = near.groupBy("a", "label").agg(F.sum("weight").alias("votes"))
        best = votes.groupBy("a").agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("to"))
        moved = T.write_once(best.select(F.col("a").alias("node"), "to").join(label, "node").where("to <> label").select("node", "to"))
        now = T.write_once(label.join(moved, "node", "left").select("node", F.coalesce("to", "label").alias("label")))
        begun = turn - turn % span
        when = F.lit(begun) + F.when(F.col("la") > F.col("lb"), 0).otherwise(span) + F.col("la")
        woken = hops.join(moved.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), when.alias("turn"))
        later = T.write_once(due.where(F.col("turn") > turn).union(woken).distinct())
        T.drop_saved(label, due, moved)
        label, due = now, later
    first = label.groupBy("label").agg(F.min("node").alias("first"))
    return label.join(first, "label").select("node", "first")


def label_propagation(u: DataFrame, max_passes: int = 20, group_hops: int = 1_000_000) -> DataFrame:
    """(node, community) of ``u`` (a, b, weight, both directions): asynchronous label propagation, nodes in sorted order, ties to the least label.

    Each visit reads the labels that the visits before it wrote, but labels never leave a
    connected component: a component of at most ``group_hops`` rows is one group; larger ones
    go turn by turn, see :func:`by_turns`, with the same result. Communities are numbered by
    their least node.
    """

    def run(pdf):
        import pandas as pd

        near = {}
        for a, b, w in zip(pdf.a, pdf.b, pdf.weight):
            near.setdefault(a, {})[b] = w
        label = {n: n for n in near}
        for _ in range(max_passes):
            moved = False
            for n in sorted(near):
                votes = {}
                for other, w in near[n].items():
                    votes[label[other]] = votes.get(label[other], 0) + w
                best = min(votes, key=lambda c: (-votes[c], c))
                if best != label[n]:
                    label[n], moved = best, True
            if not moved:
                break
        first = {}
        for n in sorted(near):
            first.setdefault(label[n], n)
        return pd.DataFrame({"node": sorted(near), "first": [first[label[n]] for n in sorted(near)]})

    u = T.write_once(u)
    part = T.components(u.select(F.col("a").alias("id")), u).withColumnRenamed("id", "a")
    grouped = u.join(part, "a")
    # fewer than one for each group_hops rows of the graph
    large = F.broadcast(T.write_once(grouped.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > group_hops).select("component")))
    rows = grouped.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, "node string, first string")
    if not large.isEmpty():
        rows = rows.unionByName(by_turns(grouped.join(large, "component", "left_semi").select("a", "b", "weight"), max_passes))
    rows = T.write_once(rows)
    order = T.positions(rows.select("first").distinct(), "first").select("first", F.col("position").alias("community"))
    return rows.join(order, "first").select("node", "community")
