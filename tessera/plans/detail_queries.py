"""Queries of single parts of the front-ends, document readers, mutations and extension slots."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.traversal import scratch
from ..sources import code, stores
from ..sources.fact_tables import TABLES, audit, facts, read_table
from .event_queries import PARITY, VERSIONS, parity, versions
from .io_queries import FILLED, GOOD, python_files, sql_files, table
from .link_queries import REVIEWED, j29
from .registry import query

# --- front-ends, part by part


def edges(files, *kinds):
    found = code.extract(files).where("what = 'edge'").where(F.col("kind").isin(*kinds))
    return found.select(F.col("id").alias("src"), F.col("other").alias("dst"), "kind")


def listed(rows: list[str], source: str) -> str:
    """Oracle rows src|dst|kind; # stands for the key of ``source`` (k)."""
    return f"SELECT e[1] AS src, e[2] AS dst, e[3] AS kind FROM (SELECT string_split(replace(unnest({rows}), '#', k), '|') AS e FROM {source})"


NATIONS = "(SELECT CAST(n_nationkey AS STRING) AS k FROM nation)"


@query("s01_first_party", "SELECT doc_id, doc_id % 4 = 2 AS scanned FROM documents")
def s01(spark, d):
    folder = F.element_at(F.array(*[F.lit(x) for x in ("node_modules", ".git", "src", "build")]), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/r/"), folder, F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, d, "documents").select("doc_id", code.first_party(path).alias("scanned"))


@query("s03_front_ends", graph="SELECT regexp_extract(file, '[.][^./]+$') AS suffix, regexp_extract(file, '[.][^./]+$') IN ('.py', '.sql') AS ready, count(DISTINCT file) AS files, count(*) AS nodes FROM nodes WHERE file IS NOT NULL GROUP BY 1, 2")
def s03(spark, d):
    """Files of the graph by suffix, and whether a front-end reads them."""
    can = spark.createDataFrame(list(code.capabilities().items()), "suffix string, can boolean")
    files = facts(spark, d).nodes.where("file IS NOT NULL").groupBy("file").agg(F.count(F.lit(1)).alias("nodes"))
    by_suffix = files.groupBy(F.regexp_extract("file", r"[.][^./]+$", 0).alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("nodes").alias("nodes"))
    return by_suffix.join(F.broadcast(can), "suffix", "left").select("suffix", F.coalesce("can", F.lit(False)).alias("ready"), "files", "nodes")


@query("s16_view_reads", listed(["sql:v#|sql:t#|READS", "sql:v#|sql:regions|READS"], NATIONS))
def s16(spark, d):
    return edges(sql_files(spark, d), "READS").where(F.col("src").startswith("sql:v"))


@query("s17_altered_columns", listed(["sql:t#|sql:t#.id|CONTAINS", "sql:t#|sql:t#.r_id|CONTAINS", "sql:t#|sql:t#.extra|CONTAINS"], NATIONS))
def s17(spark, d):
    """The columns a table has once its file's ALTER statements are folded in."""
    return edges(sql_files(spark, d), "CONTAINS")


@query("s18_routines", listed(["sql:p#|sql:t#|READS", "sql:p#|sql:log|WRITES"], NATIONS))
def s18(spark, d):
    return edges(sql_files(spark, d), "READS", "WRITES").where(F.col("src").startswith("sql:p"))


@query("s82_foreign_keys", listed(["sql:t#|sql:regions|REFERENCES"], NATIONS))
def s82(spark, d):
    return edges(sql_files(spark, d), "REFERENCES")


@query("s32_placeholders", "SELECT 'sql:regions' AS id, 'Entity' AS kind")
def s32(spark, d):
    """Tables that a foreign key names and no file creates."""
    return code.merged_nodes(code.extract(sql_files(spark, d))).where("external").select("id", "kind")


@query("e13_emitted_kinds", "SELECT split_part(x, '|', 1) AS language, split_part(x, '|', 2) AS kind FROM (SELECT unnest(['py|Module', 'py|Type', 'py|Function', 'py|Field', 'sql|Entity', 'sql|Field', 'sql|Function']) AS x)")
def e13(spark, d):
    """Kinds of node that each front-end gives."""
    found = code.extract(python_files(spark, d).unionByName(sql_files(spark, d))).where("what = 'node'")
    return found.select(F.substring_index("id", ":", 1).alias("language"), "kind").distinct()


@query("s33_introspect", " UNION ALL ".join(FILLED.format(t) for t in TABLES))
def s33(spark, d):
    """Tables and columns as their own metadata has them, with the rows that hold a value."""
    found = [stores.filled_columns(read_table(spark, f"{d}/{t}.parquet")).select(F.lit(t).alias("t"), "c", "filled") for t in TABLES]
    return reduce(DataFrame.unionByName, found)


# --- documents and records


@query("s23_doc_pages", "SELECT doc_id, len(string_split(text, chr(10))) AS sections FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) <= 1000000")
def s23(spark, d):
    """Pages up to the reader's size cap, and how many parts each has."""
    docs = table(spark, d, "documents").where(F.octet_length("text") <= 1_000_000)
    return docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("sections"))


@query("s30_transcripts", "WITH a AS (SELECT sha256(text) AS sha, min(upper(source)) AS transcript FROM documents WHERE n_chars > 200 AND lang IS NOT NULL GROUP BY 1) SELECT doc_id, transcript FROM documents JOIN a ON sha256(text) = sha")
def s30(spark, d):
    """Files whose bytes have a transcript of a known version: an equi-join on the digest is the integrity check."""
    docs = table(spark, d, "documents").withColumn("sha", F.sha2("text", 256))
    known = docs.where("n_chars > 200 AND lang IS NOT NULL").groupBy("sha").agg(F.min(F.upper("source")).alias("transcript"))
    return docs.select("doc_id", "sha").join(known, "sha").select("doc_id", "transcript")


@query(
    "s45_document_tree",
    """WITH RECURSIVE walk AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT c_custkey, depth + 1 FROM walk JOIN customer ON c_custkey // 10 = id AND c_custkey > 0 WHERE depth < 2)
    SELECT id, min(depth)::BIGINT AS depth FROM walk WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY id""",
)
def s45(spark, d):
    """Documents below a root, level by level to a depth; empty ones are walked through and left out."""
    docs = table(spark, d, "customer").where("c_custkey > 0")
    hops = docs.select(F.expr("c_custkey div 10").alias("src"), F.col("c_custkey").alias("dst"))
    level = found = spark.range(1, 2).select("id", F.lit(0).cast("long").alias("depth"))
    for depth in (1, 2):
        level = hops.join(level.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), F.lit(depth).cast("long").alias("depth"))
        found = found.unionByName(level)
    filled = docs.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    return found.join(filled, "id", "left_semi").groupBy("id").agg(F.min("depth").alias("depth"))


@query("s55_run_files", "SELECT event_id, event_type AS status FROM events")
def s55(spark, d):
    """Run records written as JSON and read by schema: fields it doesn't name are dropped."""
    path = scratch(spark, "runs")
    table(spark, d, "events").select("event_id", F.col("event_type").alias("status"), "value").write.json(path)
    return spark.read.schema("event_id long, status string").json(path)


CASE = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag"


@query("s59_case_errors", f"SELECT 'gap' AS why, count(*) AS n FROM (({CASE} = 'A') EXCEPT ({CASE} = 'R')) UNION ALL SELECT 'false positive', count(*) FROM (({CASE} = 'N') INTERSECT ({CASE} = 'R'))")
def s59(spark, d):
    """A known gap must be a labelled edge and a false positive must not."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_partkey")
    flagged = lambda x: li.where(F.col("l_returnflag") == x).select("l_suppkey", "l_partkey").distinct()
    key = ["l_suppkey", "l_partkey"]
    gaps = flagged("A").join(flagged("R"), key, "left_anti").agg(F.lit("gap").alias("why"), F.count("*").alias("n"))
    return gaps.unionByName(flagged("N").join(flagged("R"), key, "left_semi").agg(F.lit("false positive").alias("why"), F.count("*").alias("n")))


@query("s64_services", "SELECT DISTINCT p_brand, CASE WHEN p_name LIKE '%red%' THEN 'Red' WHEN p_name LIKE '%ring%' THEN 'Ring' WHEN p_name LIKE '%small%' THEN 'Small' END AS service FROM part WHERE regexp_matches(p_name, 'red|ring|small')")
def s64(spark, d):
    """Services by their images: the first label that fits counts."""
    image = F.lower(F.regexp_extract(F.concat(F.lit("  image: 'hub/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("'")), r"image:\s*['\"]?([\w./-]+)", 1))
    label = F.coalesce(*[F.when(F.contains(image, F.lit(k)), k.title()) for k in ("red", "ring", "small")])
    return table(spark, d, "part").select("p_brand", label.alias("service")).where("service IS NOT NULL").distinct()


@query("s86_requirements", "SELECT n_nationkey, unnest([n_name || ': it SHALL hold', 'Plain']) AS requirement, unnest([2, 0])::BIGINT AS scenarios FROM nation")
def s86(spark, d):
    """Requirements of a page, each up to the next one's heading, with the number of their scenarios."""
    page = F.concat(F.lit("# Spec\n### Requirement: "), "n_name", F.lit("\nit SHALL\nhold\n#### Scenario: a\n- GIVEN x\n#### Scenario: b\n- WHEN y\n### Requirement: Plain\n"))
    blocks = F.slice(F.split(page, r"(?m)^### Requirement:\s*"), 2, 1_000_000)
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(blocks).alias("b"))
    head, body = F.trim(F.substring_index("b", "\n", 1)), F.regexp_extract("b", r"(?s)^[^\n]*\n(.*?)(?=^#### Scenario:|\z)".replace("(?s)", "(?sm)"), 1)
    said = F.trim(F.regexp_replace(body, r"\s+", " "))
    return rows.select("n_nationkey", F.when(said == "", head).otherwise(F.concat(head, F.lit(": "), said)).alias("requirement"), F.regexp_count("b", F.lit("(?m)^#### Scenario:")).cast("long").alias("scenarios"))


# --- mentions and scalars


@query("f15_can_drift", "SELECT p_partkey, [false, false, true, false, true, false][p_partkey % 6 + 1] AS drifts FROM part")
def f15(spark, d):
    cases = [("camel", "PartTable"), ("backtick", "MAX_SIZE"), ("file", "src/parts.py"), ("file", "/etc/*.conf"), ("backtick", "parts.total()"), ("backtick", "parts")]
    pick = F.element_at(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("text")) for a, b in cases]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.can_drift(pick["kind"], pick["text"]).alias("drifts"))


@query("d11r_doc_drift", REVIEWED + ", gone AS (SELECT page, mention FROM reviewed WHERE drifts) SELECT 'total' AS what, CAST(count(*) AS STRING) AS value FROM gone UNION ALL SELECT 'first', CAST(page AS STRING) || ' ' || mention FROM (SELECT * FROM gone ORDER BY page, mention LIMIT 8)")
def d11r(spark, d):
    """How many claims of the documents bind to nothing, and the first eight."""
    gone = j29(spark, d).select("page", "mention")
    first = gone.orderBy("page", "mention").limit(8).select(F.lit("first").alias("what"), F.concat_ws(" ", F.col("page").cast("string"), "mention").alias("value"))
    return gone.agg(F.lit("total").alias("what"), F.count("*").cast("string").alias("value")).unionByName(first)


@query("d25_surplus", f"SELECT file, in_graph - declared AS surplus FROM ({PARITY}) WHERE in_graph > declared")
def d25(spark, d):
    return parity(spark, d).where("in_graph > declared").select("file", (F.col("in_graph") - F.col("declared")).alias("surplus"))


#: What stands before and after the text of a node of a rich-text document; others add nothing.
AROUND = {"listItem": ("- ", "\n"), "paragraph": ("", "\n"), "heading": ("", "\n"), "codeBlock": ("", "\n")}


def rich_text(node) -> str:
    if isinstance(node, list):
        return "".join(map(rich_text, node))
    if not isinstance(node, dict):
        return node if isinstance(node, str) else ""
    kind = node.get("type")
    if kind in ("text", "hardBreak"):
        return "\n" if kind == "hardBreak" else str(node.get("text", ""))
    before, after = AROUND.get(kind, ("", ""))
    inner = rich_text(node.get("content") or [])
    return before + (inner.strip() if kind == "listItem" else inner) + after


@query("x24_rich_text", "SELECT n_nationkey, n_name || chr(10) || '- k' || CAST(n_regionkey AS STRING) || chr(10) AS text FROM nation")
def x24(spark, d):
    @F.pandas_udf("string")
    def render(docs: pd.Series) -> pd.Series:
        return docs.map(lambda x: rich_text(json.loads(x)))

    doc = F.concat(
        F.lit('{"type":"doc","content":[{"type":"heading","content":[{"type":"text","text":"'), "n_name", F.lit('"}]},{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"k'),
        F.col("n_regionkey").cast("string"), F.lit('"}]}]}]}]}'),
    )
    return table(spark, d, "nation").select("n_nationkey", render(doc).alias("text"))


def window_within(sizes: list[int], at: int, room: int) -> tuple[int, int]:
    """The widest run of lines around line ``at`` that takes turns upwards and downwards and stays below ``room``."""
    ends, used = [at, at], sizes[at] + 1
    open_sides = [(0, -1), (1, 1)]
    while open_sides and used < room:
        still = []
        for side, step in open_sides:
            to = ends[side] + step
            if 0 <= to < len(sizes) and used + sizes[to] + 1 < room:
                ends[side], used = to, used + sizes[to] + 1
                still.append((side, step))
        open_sides = still
    return ends[0], ends[1]


@query("x39_line_window", "SELECT n_nationkey, 5 - (m + 1) // 2 AS low, 5 + m // 2 AS high FROM (SELECT n_nationkey, greatest(0, least(10, CAST(ceil(60.0 / (length(n_name) + 1)) AS BIGINT) - 2)) AS m FROM nation)")
def x39(spark, d):
    @F.pandas_udf("struct<low: long, high: long>")
    def around(sizes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([window_within(list(x), 5, 60) for x in sizes], columns=["low", "high"])

    sizes = F.array_repeat(F.length("n_name"), 11)
    return table(spark, d, "nation").select("n_nationkey", around(sizes).alias("w")).select("n_nationkey", "w.low", "w.high")


# --- mutations, jobs and registries


@query("m11_deprecate", f"SELECT pk, CASE WHEN status = 'F' AND version = '0.1' THEN 'deprecated' ELSE status END AS status FROM ({VERSIONS})")
def m11(spark, d):
    gone = (F.col("status") == "F") & (F.col("version") == "0.1")
    return versions(spark, d).select("pk", F.when(gone, "deprecated").otherwise(F.col("status")).alias("status"))


@query("m14_linked_insert", audit="SELECT pk, md5(lag(CAST(pk AS STRING) || action) OVER (PARTITION BY resource_id ORDER BY pk)) AS previous FROM audit WHERE resource_type = 'approval'")
def m14(spark, d):
    """Each approval carries the digest of the one before it in its run."""
    order = Window.partitionBy("resource_id").orderBy("pk")
    rows = audit(spark, d).where("resource_type = 'approval'")
    return rows.select("pk", F.md5(F.lag(F.concat(F.col("pk").cast("string"), "action")).over(order)).alias("previous"))


@query("t05_job_progress", audit="SELECT resource_id AS job, min(pk) AS started, count(*) FILTER (action IN ('view', 'click')) AS progress, max(pk) FILTER (action IN ('purchase', 'error')) AS ended FROM audit GROUP BY 1")
def t05(spark, d):
    act = F.col("action")
    return audit(spark, d).groupBy(F.col("resource_id").alias("job")).agg(
        F.min("pk").alias("started"), F.count_if(act.isin("view", "click")).alias("progress"), F.max(F.when(act.isin("purchase", "error"), F.col("pk"))).alias("ended")
    )


@query("e12_replace_by_id", "SELECT user_id AS id, arg_max(event_type, event_id) AS capability FROM events GROUP BY 1")
def e12(spark, d):
    """A registry whose last entry of an id holds; also what readers, tools and handlers are looked up by (E02, E03, E04)."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("capability"))
