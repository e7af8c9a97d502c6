"""Reachability, components and cycles over edge tables.

A frontier is joined with the edges until it is empty; visited nodes leave by an anti-join,
so cycles end. Each step's frontier is cut from its lineage by a checkpoint when a walk may
be long; short bounded walks stay one plan.
"""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_root(spark) -> str:
    """The folder in ``spark.checkpoint.dir``; without one, a folder in the warehouse in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch(spark, label: str) -> str:
    """A new folder's path in the session's shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _cut(df: DataFrame) -> DataFrame:
    """Written once to the session's shared folder and read from there: computed once, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession, "walk")
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[saved] = path
    return saved


def drop_saved(*saved: DataFrame) -> None:
    """Delete what :data:`write_once` wrote, once nothing that is still to be computed reads it."""
    for df in saved:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


#: For rows that are dear to make and read more than once.
write_once = _cut


def reach(starts: DataFrame, hops: DataFrame, max_depth: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(start, node, hop): nodes reached from each start over ``hops`` (a -> b), with the least number of hops.

    A start is not in its own result unless another start reaches it. ``known`` (id):
    nodes outside it are neither reported nor walked through. ``max_depth`` None: to the end.
    """
    hops = hops.select("a", "b").distinct()
    if known is not None:
        hops = hops.join(known.select(F.col("id").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    long_walk = max_depth is None or max_depth > 2
    if long_walk:
        hops = _cut(hops)
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hop"))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            frontier.join(hops, F.col("node") == F.col("a"))
            .select("start", F.col("b").alias("node"))
            .distinct()
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
            .withColumn("hop", F.lit(depth))
        )
        if long_walk:
            step = _cut(step)
            if step.isEmpty():
                break
        seen, frontier = seen.union(step), step
    return seen.where("hop > 0")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each of ``nodes`` (id) hangs together with over ``links`` (a, b), in either direction.

    Each round a component takes the smallest label that any of its members is linked with, and
    labels are followed to their own label, so distances shrink by more than half a round. What
    the labels already hold together needs no link any more.
    """
    labels = nodes.select("id", F.col("id").alias("component")).distinct()
    open_links = write_once(links.select("a", "b").where("a <> b").distinct())
    while not open_links.isEmpty():
        both = open_links.unionByName(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("component")).agg(F.min("b").alias("to")).where("to < component")
        # labels that point to labels: two jumps a round
        up = write_once(least)
        for _ in range(2):
            onward = up.select(F.col("component").alias("to"), F.col("to").alias("_on"))
            up = up.join(onward, "to", "left").select("component", F.coalesce("_on", "to").alias("to"))
        up = write_once(up)
        labels = write_once(labels.join(up, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        ends = lambda end, df: df.join(up.select(F.col("component").alias(end), F.col("to").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        open_links = write_once(ends("b", ends("a", open_links)).where("a <> b").select("a", "b").distinct())
    return labels


def acyclic_leftover(hops: DataFrame) -> DataFrame:
    """Nodes left after taking away, again and again, all without an incoming hop: empty exactly if there is no cycle."""
    left = _cut(hops.select("a", "b").distinct())
    while True:
        sources = left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")), "id", "left_anti")
        if sources.isEmpty():
            return left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct()
        left, old = _cut(left.join(sources.select(F.col("id").alias("a")), "a", "left_anti")), left
        drop_saved(old)


def strong_components(hops: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of more than one node, by the least member.

    Forward labels spread until stable; a component is what reaches its label backwards,
    too. What is settled, or can't be in a cycle, leaves; the rest goes round again.
    """
    left = _cut(hops.where("a <> b").select("a", "b").distinct())
    found = None
    while not left.isEmpty():
        # trim nodes without an incoming or outgoing hop
        core = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
        core = core.join(core.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        core = _cut(core)
        if core.count() < left.count():
            left = core
            continue
        if core.isEmpty():
            break
        label = core.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
        while True:
            spread = (
                core.join(label, F.col("a") == F.col("node"))
                .select(F.col("b").alias("node"), "label")
                .union(label)
                .groupBy("node")
                .agg(F.min("label").alias("label"))
            )
            spread = _cut(spread)
            changed = spread.join(label, ["node", "label"], "left_anti")
            done = changed.isEmpty()
            label = spread
            if done:
                break
        same = core.join(label.withColumnRenamed("node", "a").withColumnRenamed("label", "la"), "a").join(
            label.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b"
        )
        same = _cut(same.where("la = lb").select("a", "b", F.col("la").alias("label")))
        roots = label.where("node = label").select(F.col("node").alias("id"))
        back = reach(roots, same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        part = _cut(back.select("node", F.col("start").alias("component")).union(roots.select(F.col("id").alias("node"), F.col("id").alias("component"))))
        sizes = part.groupBy("component").count().where("count > 1")
        part = part.join(sizes, "component", "left_semi").select("node", "component")
        found = part if found is None else found.union(part)
        settled = back.select("node").union(roots.select(F.col("id").alias("node"))).distinct()
        left = _cut(
            same.join(settled.withColumnRenamed("node", "a"), "a", "left_anti").join(settled.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        )
    return found if found is not None else hops.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in ``order`` with ``position``, from 0, over all of them: each part is numbered by itself and moved by what stands in those before it.

    Written once, as the parts of a sort are only known when it has run. The offsets are a row a part.
    """
    parts = write_once(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
