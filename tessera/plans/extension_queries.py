"""Queries of the extension surface: contracts called from SQL, evaluation arms, stream reports, paged sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import contracts
from ..operators.traversal import scratch, write_once
from ..sources import code
from ..streaming import tail
from ..streaming.progress import ProgressRows
from .io_queries import GOOD, python_files
from .registry import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- contracts


@contracts.contract("extract.python", 1, "kind string, src string, dst string, broken boolean", finish=lambda rows: rows.groupBy("kind", "broken").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources")))
class PythonEdges:
    """A front-end: a file's edges, and a row that says so where it can't be parsed; the finishing pass counts them over all files."""

    def eval(self, row):
        try:
            for what, node, other, kind, *_ in list(code.python_facts(row["path"], row["content"])):
                if what == "edge":
                    yield kind, node, other, False
        except SyntaxError:
            yield "FILE", row["path"], None, True


@query("e01_front_end", f"""SELECT kind, false AS broken, count(*) AS n, count(DISTINCT src) AS sources FROM (
    SELECT replace(e, '#', k) AS t, string_split(t, '|')[1] AS kind, string_split(t, '|')[2] AS src FROM (SELECT k, unnest(['IMPORTS|m#', 'IMPORTS|m#', 'CONTAINS|m#', 'IMPLEMENTS|c#', 'CONTAINS|c#', 'CONTAINS|c#', 'CONTAINS|c#', 'CONTAINS|c#', 'CALLS|r#', 'CALLS|r#', 'CALLS|r#', 'CALLS|s#', 'CONTAINS|m#']) AS e FROM {GOOD}))
    GROUP BY 1 UNION ALL SELECT 'FILE', true, count(*), count(*) FROM supplier WHERE s_suppkey % 7 = 3 HAVING count(*) > 0""")
def e01(spark, d):
    """A registered front-end run over files, and its pass over all of them."""
    return contracts.run(python_files(spark, d), "extract.python")


@contracts.contract("eval.arm", 1, "task long, repeat long, accepted boolean")
class Threshold:
    def eval(self, row):
        yield row["task"], row["repeat"], row["value"] > 10


@contracts.contract("eval.arm", 2, "task long, repeat long, accepted boolean")
class Placeholder:
    def eval(self, row):
        yield row["task"], row["repeat"], None


@contracts.contract("eval.arm", 2, "task long, repeat long, accepted boolean")
class Improving:
    """Accepts what is better than all earlier repeats of its task; takes the place of the one registered before."""

    def __init__(self):
        self.best = None

    def eval(self, row):
        yield row["task"], row["repeat"], self.best is None or row["value"] > self.best
        self.best = row["value"] if self.best is None else max(self.best, row["value"])


REPEATS = "SELECT user_id AS task, CAST(event_id AS BIGINT) AS repeat, value FROM events"


@query("e03_contract_versions", f"""SELECT 'eval_arm_v1' AS contract, count(*) FILTER (value > 10) AS accepted, count(*) AS n FROM ({REPEATS})
    UNION ALL SELECT c, count(*) FILTER (best IS NULL OR value > best), count(*) FROM (SELECT value, max(value) OVER (PARTITION BY task ORDER BY repeat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ({REPEATS})), (SELECT unnest(['eval_arm_v2', 'eval_arm']) AS c) GROUP BY c""")
def e03(spark, d):
    """A contract by version and by id alone, which is its highest version; the last registration of a version holds."""
    contracts.install(spark)
    rows = write_once(table(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("repeat"), "value"))
    rows.createOrReplaceTempView("contract_rows")
    call = "SELECT '{0}' AS contract, count_if(accepted) AS accepted, count(*) AS n FROM {0}(TABLE(SELECT * FROM contract_rows) PARTITION BY task ORDER BY repeat)"
    return spark.sql(" UNION ALL ".join(call.format(name) for name in ("eval_arm_v1", "eval_arm_v2", "eval_arm")))


@query("e10_run_eval", f"""SELECT arm, count(*) AS tasks, sum(n)::BIGINT AS runs, sum(a)::BIGINT AS accepted, count(*) FILTER (a = n) AS always, count(*) FILTER (a > 0) AS ever FROM (
    SELECT 'threshold' AS arm, task, count(*) AS n, count(*) FILTER (value > 10) AS a FROM ({REPEATS}) GROUP BY task
    UNION ALL SELECT 'improving', task, count(*), count(*) FILTER (best IS NULL OR value > best) FROM (SELECT task, value, max(value) OVER (PARTITION BY task ORDER BY repeat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ({REPEATS})) GROUP BY task) GROUP BY arm""")
def e10(spark, d):
    """Every task's repeats through two registered arms, as a scorecard: runs and acceptances, tasks always and ever accepted."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("repeat"), "value")
    arms = [contracts.run(rows, "eval.arm", v, by=("task",), order=("repeat",)).withColumn("arm", F.lit(name)) for name, v in (("threshold", 1), ("improving", 2))]
    tasks = arms[0].unionByName(arms[1]).groupBy("arm", "task").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("a"))
    return tasks.groupBy("arm").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("runs"), F.sum("a").alias("accepted"), F.count_if(F.col("a") == F.col("n")).alias("always"), F.count_if(F.col("a") > 0).alias("ever")
    )


# --- what streams report


@query("t06_stream_progress", "SELECT what, n, rows FROM (SELECT 'progress' AS what, count(DISTINCT event_id % 8) AS n, count(*)::BIGINT AS rows FROM events UNION ALL SELECT 'started', 1, NULL UNION ALL SELECT 'ended', 1, NULL)")
def t06(spark, d):
    """Every batch of a stream over the events as its listener saw it, added up; the table comes in a file for each remainder of its ids."""
    name = f"progress_{uuid.uuid4().hex}"
    source = scratch(spark, "events")
    events = table(spark, d, "events")
    events.withColumn("part", F.col("event_id") % 8).repartition("part").write.partitionBy("part").parquet(source)
    with ProgressRows(spark, name) as reports:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
        tail.drain(stream.select("event_id"), name)
        rows = reports.rows().where("what <> 'idle' AND (what <> 'progress' OR rows > 0)")
        counted = write_once(rows.groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")))
    return counted


# --- document services


def served(spark, items, size: int = 20):
    """``items`` saved as pages of about ``size`` and read back through the source; the pages go when the driver's JVM ends."""
    from ..sources.paged import read_pages, save_pages

    path = scratch(spark, "pages")
    pages = max(1, -(-items.count() // size))
    save_pages(items, path, pages, F.pmod(F.xxhash64("id"), F.lit(pages)))
    return read_pages(spark, path)


@query("s47_issue_documents", """SELECT 'I-' || conv_id AS id, 'Issue ' || conv_id AS title, CASE WHEN conv_id > 0 THEN 'I-' || (conv_id // 4) END AS parent, sha256(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id""")
def s47(spark, d):
    """Issues with their parents, from a tracker's pages: a conversation is an issue, its turns are the text."""
    said = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("t"))
    number = lambda c: F.concat(F.lit("I-"), c.cast("string"))
    items = turns.select(
        number(F.col("conv_id")).alias("id"), F.concat(F.lit("Issue "), F.col("conv_id").cast("string")).alias("title"),
        F.array_join(F.transform("t", lambda x: x["said"]), "\n").alias("text"), F.when(F.col("conv_id") > 0, number(F.floor(F.col("conv_id") / 4))).alias("parent"),
    )
    return served(spark, items).select("id", "title", "parent", F.sha2("text", 256).alias("text_sha256"))


@query("s50_service_documents", """SELECT 'doc://' || page_id AS id, url AS title, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS parent, sha256(html) AS text_sha256 FROM pages""")
def s50(spark, d):
    """Documents of a service's resources: every page by its address, under its host."""
    rows = table(spark, d, "pages")
    items = rows.select(F.concat(F.lit("doc://"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("title"), F.col("html").alias("text"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("parent"))
    return served(spark, items).select("id", "title", "parent", F.sha2("text", 256).alias("text_sha256"))
