"""Queries of code front-ends, exports, folds and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import neighbours as N
from ..operators.traversal import scratch
from ..sources import code, exports, stores
from ..sources.fact_tables import facts
from ..streaming import tail as S
from .registry import query


#: Oracle of the columns of a table and the rows that hold a value in each.
FILLED = r"""SELECT '{0}' AS t, c, filled FROM (UNPIVOT (SELECT count(COLUMNS('(.*)')) AS "\1" FROM {0}) ON COLUMNS(*) INTO NAME c VALUE filled)"""


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def python_files(spark, d):
    k = F.col("s_suppkey").cast("string")
    body = F.concat(
        F.lit("import os\nfrom shop.base import Base, helper\n\n\nclass S"), k, F.lit("(Base):\n    kind = "), F.col("s_nationkey").cast("string"),
        F.lit("\n\n    def run(self, x):\n        self.total = os.getpid()\n        return self.stop(helper(x))\n\n    def stop(self, x):\n        return local(x)\n\n\ndef local(x):\n    return x\n"),
        F.when(F.col("s_suppkey") % 7 == 3, F.lit("def broken(:\n")).otherwise(F.lit("")),
    )
    return table(spark, d, "supplier").select(F.concat(F.lit("/r/src/shop/s"), k, F.lit(".py")).alias("path"), body.alias("content"))


GOOD = "(SELECT CAST(s_suppkey AS STRING) AS k FROM supplier WHERE s_suppkey % 7 <> 3)"


@query(
    "s04_python_edges",
    f"""SELECT 'py:shop.s' || k || e[1] AS src, replace(e[2], '@', 'py:shop.s' || k) AS dst, e[3] AS kind, CAST(e[4] AS BIGINT) AS line FROM (
        SELECT k, replace(unnest(['|py:os|IMPORTS|1', '|py:shop.base|IMPORTS|2', '|@.S#|CONTAINS|5', '.S#|py:shop.base.Base|IMPLEMENTS|5', '.S#|@.S#.kind|CONTAINS|6',
            '.S#|@.S#.total|CONTAINS|9', '.S#|@.S#.run|CONTAINS|8', '.S#|@.S#.stop|CONTAINS|12', '.S#.run|py:os.getpid|CALLS|9', '.S#.run|@.S#.stop|CALLS|10',
            '.S#.run|py:shop.base.helper|CALLS|10', '.S#.stop|@.local|CALLS|13', '|@.local|CONTAINS|16']), '#', k) AS t FROM {GOOD}), LATERAL (SELECT string_split(t, '|') AS e)""",
)
def s04(spark, d):
    return code.extract(python_files(spark, d)).where("what = 'edge'").select(F.col("id").alias("src"), F.col("other").alias("dst"), "kind", "line")


@query("s02_skipped_files", "SELECT '/r/src/shop/s' || CAST(s_suppkey AS STRING) || '.py' AS path FROM supplier WHERE s_suppkey % 7 = 3")
def s02(spark, d):
    return code.extract(python_files(spark, d)).where("what = 'skipped'").select("path")


@query("s06_python_nodes", f"SELECT kind, count(*) AS n FROM (SELECT unnest(['Module', 'Type', 'Function', 'Function', 'Function', 'Field', 'Field']) AS kind FROM {GOOD} UNION ALL SELECT unnest(['Module', 'Module'])) GROUP BY kind")
def s06(spark, d):
    return code.merged_nodes(code.extract(python_files(spark, d))).groupBy("kind").agg(F.count("*").alias("n"))


def sql_files(spark, d):
    k = F.col("n_nationkey").cast("string")
    body = F.concat(
        F.lit("-- tables; of a nation\nCREATE TABLE t"), k, F.lit(" (id INT PRIMARY KEY, name VARCHAR(10), r_id INT REFERENCES regions(id));\nALTER TABLE t"), k,
        F.lit(" ADD COLUMN extra INT;\nALTER TABLE t"), k, F.lit(" DROP COLUMN name;\nCREATE VIEW v"), k, F.lit(" AS SELECT a.id FROM t"), k,
        F.lit(" a JOIN regions r ON r.id = a.r_id;\nCREATE PROCEDURE p"), k, F.lit("() BEGIN INSERT INTO log SELECT id FROM t"), k, F.lit(" END;\n"),
    )
    return table(spark, d, "nation").select(F.concat(F.lit("/r/db/n"), k, F.lit(".sql")).alias("path"), body.alias("content"))


@query(
    "s14_sql_edges",
    """SELECT e[1] AS src, e[2] AS dst, e[3] AS kind FROM (SELECT replace(unnest(['sql:t#|sql:t#.id|CONTAINS', 'sql:t#|sql:t#.r_id|CONTAINS', 'sql:t#|sql:t#.extra|CONTAINS', 'sql:t#|sql:regions|REFERENCES',
        'sql:v#|sql:t#|READS', 'sql:v#|sql:regions|READS', 'sql:p#|sql:t#|READS', 'sql:p#|sql:log|WRITES']), '#', CAST(n_nationkey AS STRING)) AS t FROM nation), LATERAL (SELECT string_split(t, '|') AS e)""",
)
def s14(spark, d):
    return code.extract(sql_files(spark, d)).where("what = 'edge'").select(F.col("id").alias("src"), F.col("other").alias("dst"), "kind")


@query("m01_fold_migrations", "SELECT 't' || CAST(n_nationkey AS STRING) AS name, 'extra,id,r_id' AS columns FROM nation")
def m01(spark, d):
    """The schema after a file's ordered statements; files are independent groups."""

    def fold(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(n, ",".join(sorted(t["columns"]))) for text in pdf["content"] for n, t in code.fold_schema([s for _, s in code.statements(text)]).items()]
            yield pd.DataFrame(rows, columns=["name", "columns"])

    return sql_files(spark, d).mapInPandas(fold, "name string, columns string")


@query("s31_schema_to_facts", f"SELECT 'db:' || t AS src, 'db:' || t || '.' || c AS dst, filled FROM ({FILLED.format('part')} UNION ALL {FILLED.format('nation')})")
def s31(spark, d):
    """CONTAINS facts of two stored tables, each with the rows that hold a value."""
    part, nation = (stores.filled_columns(table(spark, d, t)).select(F.lit(f"db:{t}").alias("src"), F.concat(F.lit(f"db:{t}."), "c").alias("dst"), "filled") for t in ("part", "nation"))
    return part.unionByName(nation)


@query("s34_rows_to_schema", "SELECT l_returnflag AS t, string_agg(l_linestatus, ',' ORDER BY l_linestatus) AS columns FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) GROUP BY 1")
def s34(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("t"), "l_linestatus").distinct()
    return rows.groupBy("t").agg(F.array_join(F.array_sort(F.collect_list("l_linestatus")), ",").alias("columns"))


@query("s35_lenient_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s35(spark, d):
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"rows": ['), "props", F.lit("]}"))).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    rows = F.coalesce(F.from_json(F.get_json_object(wrapped, "$.rows"), "array<struct<k:long>>"), F.from_json(wrapped, "array<struct<k:long>>"))
    return table(spark, d, "events").select("event_id", F.explode(rows).alias("r")).select("event_id", "r.k")


@query("s41_commit_keys", r"SELECT event_id, nullif(regexp_extract(event_type || ' T-' || CAST(user_id AS STRING) || CASE WHEN user_id % 4 = 0 THEN ' PROJ-' || CAST(event_id AS STRING) ELSE '' END, '\b[A-Z][A-Z0-9]{1,9}-\d+\b'), '') AS issue FROM events")
def s41(spark, d):
    message = F.concat("event_type", F.lit(" T-"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 4 == 0, F.concat(F.lit(" PROJ-"), F.col("event_id").cast("string"))).otherwise(""))
    return table(spark, d, "events").select("event_id", F.nullif(F.regexp_extract(message, r"\b[A-Z][A-Z0-9]{1,9}-\d+\b", 0), F.lit("")).alias("issue"))


@query("s43_recent_areas", "SELECT area, n FROM (SELECT '/' || string_split(split_part(url, '://', 2), '/')[2] AS area, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, area LIMIT 6")
def s43(spark, d):
    area = F.concat(F.lit("/"), F.get(F.split(F.get(F.split("url", "://"), F.lit(1)), "/"), F.lit(1)))
    return table(spark, d, "pages").groupBy(area.alias("area")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area").limit(6)


@query("s62_languages", graph="SELECT DISTINCT CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.go' THEN 'go' WHEN file LIKE '%.sql' THEN 'sql' WHEN file LIKE '%.md' THEN 'markdown' END AS language FROM nodes WHERE file IS NOT NULL")
def s62(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("py", "python", "go", "go", "sql", "sql", "md", "markdown")])
    return facts(spark, d).nodes.where("file IS NOT NULL").select(names[F.substring_index("file", ".", -1)].alias("language")).distinct()


@query("s51_warehouse", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def s51(spark, d):
    return table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-12'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("s60_tool_counts", "SELECT event_type AS tool, user_id AS code, count(*) AS n FROM events GROUP BY 1, 2")
def s60(spark, d):
    line = F.format_string("%s:%d: bad", "event_type", "user_id")
    rows = table(spark, d, "events").select(F.regexp_extract(line, r"^(\w+):", 1).alias("tool"), F.regexp_extract(line, r":(\d+):", 1).cast("long").alias("code"))
    return rows.groupBy("tool", "code").agg(F.count("*").alias("n"))


# --- exports


@query("k01_round_trip", graph="SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def k01(spark, d):
    """Facts saved and loaded again, in the session's shared folder."""
    path = scratch(spark, "facts")
    exports.save(facts(spark, d), path)
    back = exports.load(spark, path)
    return back.nodes.agg(F.count("*").alias("nodes")).join(back.edges.agg(F.count("*").alias("edges")))


@query("k02_node_documents", graph="""SELECT id, '{"id":"' || id || '","kind":"' || kind || '","name":"' || name || '","language":"' || language || '","provenance":' || CASE WHEN file IS NULL THEN 'null' ELSE '{"file":"' || file || '","line":' || CAST(line AS STRING) || ',"end_line":' || CAST(end_line AS STRING) || '}' END || ',"external":' || CAST(external AS STRING) || '}' AS json FROM nodes WHERE kind IN ('Module', 'Type', 'Function')""")
def k02(spark, d):
    return exports.node_documents(facts(spark, d).nodes.where("kind IN ('Module', 'Type', 'Function')"))


@query("k03_tables_by_kind", graph="SELECT 'modules' AS t, count(*) AS n FROM nodes WHERE kind = 'Module' UNION ALL SELECT 'types', count(*) FROM nodes WHERE kind = 'Type' UNION ALL SELECT 'functions', count(*) FROM nodes WHERE kind = 'Function' UNION ALL SELECT 'calls', count(*) FROM (SELECT DISTINCT e.src, e.dst FROM edges e JOIN nodes a ON a.id = e.src AND a.kind = 'Function' JOIN nodes b ON b.id = e.dst AND b.kind = 'Function' WHERE e.kind = 'CALLS')")
def k03(spark, d):
    parts = [df.agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t, df in exports.tables_by_kind(facts(spark, d)).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("k04_graphml", graph="""SELECT '<node id="' || id || '"><data key="kind">' || kind || '</data></node>' AS line FROM nodes WHERE kind = 'Module' UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="kind">' || kind || '</data></edge>' FROM edges WHERE kind = 'IMPORTS'""")
def k04(spark, d):
    g = facts(spark, d)
    part = type(g)(g.nodes.where("kind = 'Module'"), N.edges_of_kind(g, "IMPORTS"))
    return exports.graphml_lines(part).select("line")


@query("k05_dot", graph="""SELECT '"' || src || '" -> "' || dst || '" [label=' || kind || '];' AS line FROM edges WHERE kind IN ('IMPORTS', 'IMPLEMENTS')""")
def k05(spark, d):
    g = facts(spark, d)
    return exports.dot_lines(type(g)(g.nodes, N.edges_of_kind(g, "IMPORTS", "IMPLEMENTS")))


@query("k06_json_summary", graph="""SELECT kind, '{"kind":"' || kind || '","n":' || CAST(count(*) AS STRING) || '}' AS json FROM edges GROUP BY kind""")
def k06(spark, d):
    n = facts(spark, d).edges.groupBy("kind").agg(F.count("*").alias("n"))
    return n.select("kind", F.to_json(F.struct("kind", "n")).alias("json"))


@query("k08_triples", graph="SELECT p, count(*) AS n FROM (SELECT 'type' AS p FROM nodes UNION ALL SELECT 'name' FROM nodes UNION ALL SELECT p FROM (SELECT DISTINCT src, lower(kind) AS p, dst FROM edges)) GROUP BY p")
def k08(spark, d):
    return exports.triples(facts(spark, d)).groupBy("p").agg(F.count("*").alias("n"))


@query("k09_wikilinks", graph="SELECT id, 'see [[' || replace(name, '.', '-') || '|' || name || ']] there' AS text FROM nodes WHERE kind = 'Module'")
def k09(spark, d):
    text = F.concat(F.lit("see ["), "name", F.lit("]("), F.replace("name", F.lit("."), F.lit("-")), F.lit(".md) there"))
    return facts(spark, d).nodes.where("kind = 'Module'").select("id", exports.wikilinks(text).alias("text"))


@query("k12_layout", graph="SELECT id, (rn - 1) // 8 AS column_no, (rn - 1) % 8 AS row_no FROM (SELECT id, row_number() OVER (PARTITION BY split_part(name, '.', 1) ORDER BY name, id) AS rn FROM nodes WHERE kind = 'Module')")
def k12(spark, d):
    from pyspark.sql.window import Window

    rn = F.row_number().over(Window.partitionBy(F.substring_index("name", ".", 1)).orderBy("name", "id")) - 1
    mods = facts(spark, d).nodes.where("kind = 'Module'").withColumn("rn", rn)
    return mods.select("id", F.floor(F.col("rn") / 8).cast("long").alias("column_no"), (F.col("rn") % 8).cast("long").alias("row_no"))


# --- streams, drained over what is there


def stream(spark, d):
    """The events table as a stream; a table that is one file is read through its folder."""
    if spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet").getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")).isDirectory():
        return S.tail(spark, f"{d}/events.parquet")
    return spark.readStream.schema(S.EVENT).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def name():
    return f"q_{uuid.uuid4().hex}"


@query("t01_tail", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def t01(spark, d):
    rows = stream(spark, d).where(F.col("event_type").isin("error", "purchase")).select("event_id", "event_type")
    return S.drain(rows, name())


@query("t01b_daily_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t01b(spark, d):
    return S.drain(S.windowed(stream(spark, d)), name(), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: A bucket of two tokens, refilled by elapsed time, folded over each user's events.
BUCKETS = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f AS (SELECT user_id, event_id, r, now AS last, 1.0::DOUBLE AS tokens, true AS allowed, 0.0::DOUBLE AS retry FROM e WHERE r = 1
        UNION ALL SELECT user_id, event_id, r, greatest(last, now), CASE WHEN level >= 1 THEN level - 1 ELSE level END, level >= 1, CASE WHEN level >= 1 THEN 0.0 ELSE (1 - level) / 0.000025::DOUBLE END
        FROM (SELECT e.*, f.last, least(2.0::DOUBLE, f.tokens + greatest(0.0::DOUBLE, e.now - f.last) * 0.000025::DOUBLE) AS level FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))"""


@query("t03_rate_limit", f"{BUCKETS} SELECT user_id, event_id, allowed, round(retry, 3) AS retry_after FROM f")
def t03(spark, d):
    return S.drain(S.rate_limited(stream(spark, d), 2, 1 / 40_000), name()).withColumn("retry_after", F.round("retry_after", 3))


@query("t04_bucket_per_key", f"{BUCKETS} SELECT user_id, count(*) AS n, count(*) FILTER (allowed) AS allowed, round(max(retry), 3) AS longest_wait FROM f GROUP BY user_id")
def t04(spark, d):
    """Each user's own bucket: how many of the events it let through, and the longest wait it asked for."""
    taken = S.drain(S.rate_limited(stream(spark, d), 2, 1 / 40_000), name())
    return taken.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"), F.round(F.max("retry_after"), 3).alias("longest_wait"))


@query("t07_timeout_sweep", "SELECT event_id AS pk FROM events WHERE event_type = 'view' AND epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) >= CAST(json_extract(props, '$.k') AS BIGINT) * 1000")
def t07(spark, d):
    pending = table(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("pk"), F.col("ts").alias("created"), (F.get_json_object("props", "$.k").cast("long") * 1000).alias("after_seconds"))
    return S.due(pending, "2024-01-20 00:00:00")
