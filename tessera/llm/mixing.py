"""Mixing sources to target weights by minimum-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern, so the
flow network has a node for each pattern and each source and its size doesn't follow the
number of documents. A pattern supplies its size once at cost 0 and again at growing cost
for each repetition, a source demands its quota, and the cheapest flow repeats as little as
it can. Within a pattern, each source takes whole copies and then a share of the documents
in an order that a seeded hash of the id fixes, so reruns agree.

The cut in that order is found by two histograms of hash bits and a running sum over the
few documents in the last cell; what is left is filled by the largest documents that fit,
found by aggregates. No source or pattern is ever one task's work.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, materialise

CELLS = 4096


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), budget_percent: int = 150, most_copies: int = 2, total: int | None = None) -> dict[str | None, float]:
    """Words wanted from each source: ``budget_percent`` of all sizes, shared by weight.

    Sources stand by code point, null last, and take ``weights`` in turn. No target exceeds
    ``most_copies`` times its source; what is over is shared among the others by weight,
    until none is above. ``total``: all sizes, where sources overlap.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target: dict[str | None, float] = {}
    rest, free = budget_percent * (sum(sizes.values()) if total is None else total) / 100, list(names)
    while free:
        shares = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / shares > most_copies * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / shares for s in free}
            break
        for s in over:
            target[s] = float(most_copies * sizes[s])
            rest -= target[s]
        rest, free = max(0.0, rest), [s for s in free if s not in over]
    return target


def route(supply: list[int], members: list[list[int]], demand: list[int], most_copies: int = 2) -> dict[tuple[int, int], int]:
    """Cheapest flow from patterns to sources: (pattern, source) -> words.

    Pattern p may give at most ``most_copies`` times ``supply[p]``, the k-th copy at cost k;
    source s takes at most ``demand[s]``. Successive shortest paths with potentials.
    """
    patterns, sources = len(supply), len(demand)
    start, end = patterns + sources, patterns + sources + 1
    graph: list[list[list[int]]] = [[] for _ in range(end + 1)]  # [to, room, cost, index of the reverse]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p in range(patterns):
        for k in range(most_copies):
            arc(start, p, supply[p], k)
        for s in members[p]:
            arc(p, patterns + s, most_copies * supply[p], 0)
    for s in range(sources):
        arc(patterns + s, end, demand[s], 0)

    height = [0] * (end + 1)
    while True:
        far, came = [None] * (end + 1), [None] * (end + 1)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, at = heapq.heappop(heap)
            if d > far[at]:
                continue
            for k, (to, room, cost, _) in enumerate(graph[at]):
                new = d + cost + height[at] - height[to]
                if room and (far[to] is None or new < far[to]):
                    far[to], came[to] = new, (at, k)
                    heapq.heappush(heap, (new, to))
        if far[end] is None:
            break
        for v in range(end + 1):
            height[v] += far[v] if far[v] is not None else far[end]
        push, at = None, end
        while at != start:
            before, k = came[at]
            push = graph[before][k][1] if push is None else min(push, graph[before][k][1])
            at = before
        at = end
        while at != start:
            before, k = came[at]
            graph[before][k][1] -= push
            graph[at][graph[before][k][3]][1] += push
            at = before
    flow: dict[tuple[int, int], int] = {}
    for p in range(patterns):
        for to, _, _, back in graph[p]:
            if patterns <= to < patterns + sources and graph[to][back][1]:
                flow[p, to - patterns] = flow.get((p, to - patterns), 0) + graph[to][back][1]
    return flow


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    budget_percent: int = 150,
    most_copies: int = 2,
    seed: int = 11,
) -> DataFrame:
    """``id_col``, size, source_size, target, taken: one row for each row of ``docs``.

    ``source_col`` is a string, or an array of strings where documents belong to several
    sources; the sources of an array document count once, and an empty array or null is the
    null source. ``size`` is the number of words (0 for a null text), ``source_size`` and
    ``target`` are sums over the document's sources, and ``taken`` is size times the copies
    the mix takes, at most ``most_copies``. Whole documents are taken in seeded order while
    they fit; then three times the largest document that still fits fills what is left, and
    the smallest one is added if that brings the source nearer. So a source misses its target
    by half of its smallest document left at most, very long texts or not. Rows that repeat an id and a size share their place in the seeded order and are
    taken together; ids whose hashes tie stand by id. Other columns, whatever their names,
    are not read; an empty table gives an empty result.

    Patterns go through the driver, one row each: as many as there are distinct sets of
    sources, however many documents there are. The flow takes time by patterns squared.
    """
    spark = docs.sparkSession
    several = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    if several:
        given = F.array_sort(F.array_distinct(F.coalesce(F.col(source_col), F.array().cast("array<string>"))))
        pattern = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(None).cast("string")))
    else:
        pattern = F.array(F.col(source_col).cast("string"))
    sized = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            word_count(F.col(text_col)).alias("size"),
            pattern.alias("pattern"),
            F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"),
        ),
        "sized",
    )
    # one row for each membership pattern
    found = sorted(sized.groupBy("pattern").agg(F.sum("size").alias("n")).collect(), key=lambda r: [(x is None, x or "") for x in r["pattern"]])
    patterns, supply = [tuple(r["pattern"]) for r in found], [int(r["n"]) for r in found]
    sizes: dict[str | None, int] = {}
    for p, n in zip(patterns, supply, strict=True):
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = source_targets(sizes, weights, budget_percent, most_copies, sum(supply))
    names = list(targets)
    at = {s: k for k, s in enumerate(names)}
    flow = route(supply, [[at[s] for s in p] for p in patterns], [round(targets[s]) for s in names], most_copies)

    # a pattern's copies: whole ones for all its documents, then a share of them in seeded order
    plan, routed = [], [0] * len(patterns)
    for (a, _), v in flow.items():
        routed[a] += v
    for k, (p, n) in enumerate(zip(patterns, supply, strict=True)):
        words = routed[k]
        copies, share = divmod(words, n) if n else (0, 0)
        plan.append((list(p), k, int(copies), int(share), sum(sizes[s] for s in p), float(sum(targets[s] for s in p))))
    wanted = F.broadcast(
        spark.createDataFrame(plan, "pattern array<string>, k int, copies long, share long, source_size long, target double")
    )  # one row a pattern
    # null-safe: a pattern may hold the null source
    same = F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"})
    rows = sized.withColumn("_p", same).join(wanted.withColumn("_p", same).drop("pattern"), "_p")

    first, second = F.pmod(F.col("h"), F.lit(CELLS)), F.pmod(F.shiftright("h", 12), F.lit(CELLS))
    rows = rows.select("id", "size", "k", "copies", "share", "source_size", "target", "h", first.alias("c1"), second.alias("c2"))

    def running(counted: DataFrame, cell: str) -> DataFrame:
        """Words in earlier cells of the same pattern: at most ``CELLS`` rows a pattern."""
        order = Window.partitionBy("k").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        return counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))

    # coarse cells below the cut are taken whole; the cell with the cut is looked into, twice
    open_rows = rows.where("share > 0")
    coarse = running(open_rows.groupBy("k", "share", "c1").agg(F.sum("size").alias("n")), "c1")
    cut1 = coarse.where("before < share AND before + n >= share").select("k", F.col("c1").alias("at1"), F.col("before").alias("b1"))
    inside = open_rows.join(F.broadcast(cut1), "k").where("c1 = at1")  # at most one row a pattern is broadcast
    fine = running(inside.groupBy("k", F.expr("share - b1").alias("share"), "c2").agg(F.sum("size").alias("n")), "c2")
    cut2 = fine.where("before < share AND before + n >= share").select("k", F.col("c2").alias("at2"), F.col("before").alias("b2"))
    order = Window.partitionBy("k").orderBy("h", "id", "size")
    last = (
        inside.join(F.broadcast(cut2), "k")
        .where("c2 = at2")
        .groupBy("k", "share", "b1", "b2", "h", "id", "size")
        .agg(F.sum("size").alias("n"))  # rows that repeat all of this stand and fall together
        .withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where(F.col("upto") <= F.col("share") - F.col("b1") - F.col("b2"))
        .groupBy("k")
        .agg(F.max(F.struct("h", "id", "size")).alias("stop"), F.max("upto").alias("b3"))
    )
    cuts = spark.range(0, len(plan)).select(F.col("id").cast("int").alias("k")).join(cut1, "k", "left").join(cut2, "k", "left").join(last, "k", "left")
    cuts = materialise(cuts, "cuts")  # one row a pattern
    marked = rows.join(F.broadcast(cuts.drop("b1", "b2", "b3")), "k", "left")
    mine = F.struct("h", "id", "size")
    before = (F.col("share") > 0) & (
        (F.col("c1") < F.col("at1"))
        | (F.col("c1") == F.col("at1")) & ((F.col("c2") < F.col("at2")) | (F.col("c2") == F.col("at2")) & F.coalesce(mine <= F.col("stop"), F.lit(False)))
    )
    marked = marked.withColumn("extra", F.coalesce(before, F.lit(False)))
    # what is left of the share: past the cut, three times the largest that still fits, then the smallest if it brings
    # the source nearer; of equal ones the first in seeded order
    gaps = cuts.join(wanted.select("k", "share"), "k").where("share > 0").select("k", (F.col("share") - F.coalesce("b1", F.lit(0)) - F.coalesce("b2", F.lit(0)) - F.coalesce("b3", F.lit(0))).alias("gap"))
    for fits, prefer in [("n <= gap", F.col("n"))] * 3 + [("n < 2 * gap", -F.col("n"))]:
        picks = (
            marked.where("NOT extra AND size > 0")
            .join(F.broadcast(gaps), "k")
            .where("size < 2 * gap")
            .groupBy("k", "gap", "h", "id", "size")
            .agg(F.sum("size").alias("n"))
            .where(fits)
            .groupBy("k", "gap")
            .agg(F.max_by(F.struct("h", "id", "size", "n"), F.struct(prefer.alias("n"), (-F.col("h")).alias("h"), "id")).alias("pick"))
        )
        picks = materialise(picks, "picks")  # one row a pattern
        marked = marked.join(F.broadcast(picks.select("k", F.struct("pick.h", "pick.id", "pick.size").alias("pick"))), "k", "left")
        marked = marked.withColumn("extra", F.col("extra") | F.coalesce(mine.eqNullSafe(F.col("pick")), F.lit(False))).drop("pick")
        gaps = gaps.join(picks.select("k", "pick.n"), "k", "left").select("k", (F.col("gap") - F.coalesce("n", F.lit(0))).alias("gap"))
        gaps = materialise(gaps, "gaps")
    taken = F.col("size") * (F.col("copies") + F.col("extra").cast("long"))
    return marked.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))
