"""Facts written out: Parquet by kind, JSON, GraphML, DOT, triples, tables by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fact_tables import Facts

FORMAT_VERSION = 4


def save(facts: Facts, path: str) -> None:
    """Nodes, and edges by kind, so that a reader of one kind opens only its files."""
    facts.nodes.withColumn("version", F.lit(FORMAT_VERSION)).write.mode("overwrite").parquet(f"{path}/nodes")
    facts.edges.withColumn("version", F.lit(FORMAT_VERSION)).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")


def load(spark, path: str) -> Facts:
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if nodes.where(F.col("version") != FORMAT_VERSION).limit(1).count():
        raise ValueError(f"facts at {path} aren't of version {FORMAT_VERSION}")
    return Facts(nodes.drop("version"), edges.drop("version"))


def node_documents(nodes: DataFrame) -> DataFrame:
    """A JSON line a node, its provenance nested and null where it has none."""
    where = F.when(F.col("file").isNotNull(), F.struct("file", "line", "end_line"))
    return nodes.select("id", F.to_json(F.struct("id", "kind", "name", "language", where.alias("provenance"), "external"), {"ignoreNullFields": "false"}).alias("json"))


def escape_xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(facts: Facts) -> DataFrame:
    """The elements of a GraphML file, as (part, key, line): nodes, placeholders of dangling ends, edges."""
    nodes = facts.nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.format_string('<node id="%s"><data key="kind">%s</data></node>', escape_xml(F.col("id")), "kind").alias("line"))
    ends = facts.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(facts.nodes.select("id"), "id", "left_anti")
    loose = ends.select(F.lit(2).alias("part"), F.col("id").alias("key"), F.format_string('<node id="%s"/>', escape_xml(F.col("id"))).alias("line"))
    edges = facts.edges.select(
        F.lit(3).alias("part"), F.concat_ws("|", "src", "dst", "kind", F.col("line").cast("string")).alias("key"),
        F.format_string('<edge source="%s" target="%s"><data key="kind">%s</data></edge>', escape_xml(F.col("src")), escape_xml(F.col("dst")), "kind").alias("line"),
    )
    return nodes.unionByName(loose).unionByName(edges)


def dot_lines(facts: Facts) -> DataFrame:
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return facts.edges.select(F.format_string("%s -> %s [label=%s];", quote("src"), quote("dst"), "kind").alias("line"))


def triples(facts: Facts, namespace: str = "urn:facts:") -> DataFrame:
    """(s, p, o) of every node kind and edge kind."""
    iri = lambda c: F.concat(F.lit(namespace), F.url_encode(c))
    nodes = facts.nodes.select(iri("id").alias("s"), F.explode(F.array(F.struct(F.lit("type").alias("p"), F.col("kind").alias("o")), F.struct(F.lit("name").alias("p"), F.col("name").alias("o")))).alias("x"))
    return nodes.select("s", "x.p", "x.o").unionByName(facts.edges.select(iri("src").alias("s"), F.lower("kind").alias("p"), iri("dst").alias("o")).distinct())


def tables_by_kind(facts: Facts) -> dict[str, DataFrame]:
    """modules, types, functions with their owners, and calls whose ends are functions."""
    owner = facts.edges.where("kind = 'CONTAINS'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("owner"))
    of = lambda kind: facts.nodes.where(F.col("kind") == kind).select("id", "name", "file", "line").join(owner, "id", "left")
    functions = facts.nodes.where("kind = 'Function'").select("id")
    calls = facts.edges.where("kind = 'CALLS'").select("src", "dst").distinct()
    calls = calls.join(functions.withColumnRenamed("id", "src"), "src", "left_semi").join(functions.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return {"modules": of("Module"), "types": of("Type"), "functions": of("Function"), "calls": calls}


def wikilinks(text):
    """[label](page.md) as [[page|label]]."""
    return F.regexp_replace(text, r"\[([^\]]+)\]\(([^)#]+)\.md\)", r"[[$2|$1]]")
