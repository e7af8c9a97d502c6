"""One-hop questions about the fact graph. Each returns rows for all nodes, or for ``of`` only.

Every function is a declarative join on (edge, node), so a filter on ``of`` reaches the scan,
and with edges partitioned by kind a single kind is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fact_tables import Facts


def grounded() -> Column:
    """A node that stands in a first-party file."""
    return F.col("file").isNotNull() & ~F.col("external")


def edges_of_kind(facts: Facts, *kinds: str) -> DataFrame:
    return facts.edges.where(F.col("kind").isin(*kinds))


def incoming(facts: Facts, kind: str, of: str | None = None) -> DataFrame:
    """node, neighbour, name: a row for each ``kind`` edge into a node, from a known neighbour (a bag)."""
    edges = edges_of_kind(facts, kind)
    if of is not None:
        edges = edges.where(F.col("dst") == of)
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("id"), F.col("line").alias("at_line")).join(
        facts.nodes.select("id", "name"), "id"
    ).select("node", F.col("id").alias("neighbour"), "name", "at_line")


def outgoing(facts: Facts, kind: str, of: str | None = None) -> DataFrame:
    """node, neighbour, name: a row for each ``kind`` edge out of a node, to a known neighbour (a bag)."""
    edges = edges_of_kind(facts, kind)
    if of is not None:
        edges = edges.where(F.col("src") == of)
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("id"), F.col("line").alias("at_line")).join(
        facts.nodes.select("id", "name"), "id"
    ).select("node", F.col("id").alias("neighbour"), "name", "at_line")


def parents(facts: Facts, first: bool = False) -> DataFrame:
    """child, parent: by the last CONTAINS edge of a child, or the first."""
    pick = F.min_by if first else F.max_by
    return edges_of_kind(facts, "CONTAINS").groupBy(F.col("dst").alias("child")).agg(pick("src", "seq").alias("parent"))


def touches(facts: Facts, of: list[str]) -> DataFrame:
    """node, neighbour: distinct neighbours over any kind, either direction; a node itself only by a self-edge."""
    out = facts.edges.where(F.col("src").isin(of)).select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    into = facts.edges.where(F.col("dst").isin(of)).select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    return out.union(into).distinct().join(facts.nodes.select(F.col("id").alias("neighbour"), "name"), "neighbour").select("node", "neighbour", "name")


def find(facts: Facts, name: str) -> DataFrame:
    """Nodes by name, whatever the case; grounded ones first, then by id."""
    return (
        facts.nodes.where(F.lower("name") == name.lower())
        .withColumn("grounded", grounded())
        .orderBy(F.desc("grounded"), "id")
        .select("id", "kind", "grounded")
    )


def enclosing_symbols(spots: DataFrame, symbols: DataFrame) -> DataFrame:
    """spots (file, line) with the smallest symbol whose span holds the line; first by seq on ties.

    Equi-join on the file, range filter on the line; the smallest is an aggregate, so no
    row order and no window is needed.
    """
    spans = symbols.where(F.col("file").isNotNull()).select(
        "file", F.col("line").alias("first"), F.coalesce("end_line", "line").alias("last"), "id", "seq"
    )
    inside = spots.distinct().join(spans, "file").where(F.col("line").between(F.col("first"), F.col("last")))
    return inside.groupBy("file", "line").agg(F.min_by("id", F.struct(F.col("last") - F.col("first"), F.col("seq"))).alias("symbol"))


def innermost_spans(spots: DataFrame, spans: DataFrame) -> DataFrame:
    """spots (file, line), each once, with ``best`` (size, seq, id) of the smallest of ``spans`` (file, first, last, seq, id) that holds the line.

    A span is cut into the aligned blocks of 2^k lines that make it up, two of a size at most, and
    a line is in one block of each size. A block keeps its best span, so spots and spans meet by
    equality on a block, in rows by the logarithm of a span's length, however many spans a file has.
    """
    sized = spans.where("first <= last AND file IS NOT NULL").withColumn("_top", F.length(F.bin(F.col("last") - F.col("first") + 1)) - 1)
    ends = sized.select("file", F.struct((F.col("last") - F.col("first")).alias("size"), "seq", "id").alias("span"), "first", "last", F.explode(F.sequence(F.lit(0), "_top")).alias("k")).withColumns(
        {"l": F.expr("shiftright(first + shiftleft(1L, k) - 1, k)"), "r": F.expr("shiftright(last + 1, k)")}
    )
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    cut = F.array_compact(F.array(F.when(odd("l"), F.col("l")), F.when(odd("r"), F.col("r") - 1)))
    blocks = ends.where("l < r").select("file", "k", F.explode(cut).alias("block"), "span").groupBy("file", "k", "block").agg(F.min("span").alias("best"))
    asked = spots.select("file", "line").distinct().crossJoin(F.broadcast(sized.agg(F.max("_top").alias("_top"))))
    asked = asked.select("file", "line", F.explode(F.sequence(F.lit(0), "_top")).alias("k")).withColumn("block", F.expr("shiftright(line, k)"))
    return asked.join(blocks, ["file", "k", "block"]).groupBy("file", "line").agg(F.min("best").alias("best"))
