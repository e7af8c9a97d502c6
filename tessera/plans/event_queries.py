"""Queries over the audit log, registries, memory, approvals, calibration and evaluation outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.running import running_sum
from ..sources.fact_tables import audit
from .registry import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- audit filters


@query("f19_audit_filter", audit="SELECT pk, actor, action FROM audit WHERE tenant_id = 't1' AND action = 'purchase' AND (resource_id = 'r7' OR trace_id = 'tr7' OR actor = 'u7') ORDER BY ts DESC, pk DESC LIMIT 50")
def f19(spark, d):
    rows = audit(spark, d).where("tenant_id = 't1' AND action = 'purchase'").where((F.col("resource_id") == "r7") | (F.col("trace_id") == "tr7") | (F.col("actor") == "u7"))
    return rows.orderBy(F.desc("ts"), F.desc("pk")).limit(50).select("pk", "actor", "action")


EVENT_TYPE = "CASE WHEN action = 'error' THEN 'run.failed' WHEN action = 'purchase' THEN 'run.merged' WHEN resource_type = 'approval' THEN 'approval.' || action ELSE 'event.' || action END"


def event_type():
    a = F.col("action")
    return F.when(a == "error", "run.failed").when(a == "purchase", "run.merged").when(F.col("resource_type") == "approval", F.concat(F.lit("approval."), a)).otherwise(F.concat(F.lit("event."), a))


@query("f20_event_types", audit=f"SELECT pk, {EVENT_TYPE} AS event_type FROM audit")
def f20(spark, d):
    return audit(spark, d).select("pk", event_type().alias("event_type"))


@query("f21_event_envelopes", audit=f"""SELECT pk, '{{"type":"' || {EVENT_TYPE} || '","run":"' || resource_id || '","actor":"' || actor || '"}}' AS envelope FROM audit""")
def f21(spark, d):
    return audit(spark, d).select("pk", F.to_json(F.struct(event_type().alias("type"), F.col("resource_id").alias("run"), "actor")).alias("envelope"))


@query("f22_pending_approvals", audit="SELECT pk FROM audit WHERE resource_type = 'approval' AND action = 'view' AND tenant_id = 't0' ORDER BY ts DESC, pk DESC LIMIT 100")
def f22(spark, d):
    return audit(spark, d).where("resource_type = 'approval' AND action = 'view' AND tenant_id = 't0'").orderBy(F.desc("ts"), F.desc("pk")).limit(100).select("pk")


@query("f23_timed_out", audit="SELECT pk FROM audit WHERE resource_type = 'approval' AND action = 'view' AND epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts)) >= CAST(json_extract(props, '$.k') AS BIGINT) * 10000")
def f23(spark, d):
    rows = audit(spark, d).where("resource_type = 'approval' AND action = 'view'")
    age = F.lit(1705276800) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return rows.where(age >= F.get_json_object("props", "$.k").try_cast("long") * 10000).select("pk")


@query("f25_active_for_issue", audit="SELECT resource_id, arg_min(pk, pk) AS pk FROM audit WHERE action IN ('view', 'click') GROUP BY resource_id")
def f25(spark, d):
    return audit(spark, d).where(F.col("action").isin("view", "click")).groupBy("resource_id").agg(F.min("pk").alias("pk"))


@query("f16_material_drift", audit="SELECT pk, action FROM audit WHERE CASE action WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END >= 2")
def f16(spark, d):
    rank = F.coalesce(F.create_map(*[F.lit(x) for x in ("error", 3, "purchase", 2, "signup", 1)])[F.col("action")], F.lit(0))
    return audit(spark, d).where(rank >= 2).select("pk", "action")


@query("f17_drift_layers", audit="SELECT pk, CASE lower(action) WHEN 'view' THEN 'L1' WHEN 'click' THEN 'L2' WHEN 'error' THEN 'L3' ELSE '' END AS layer FROM audit")
def f17(spark, d):
    layers = F.create_map(*[F.lit(x) for x in ("view", "L1", "click", "L2", "error", "L3")])
    return audit(spark, d).select("pk", F.coalesce(layers[F.lower("action")], F.lit("")).alias("layer"))


# --- runs

STATE = "CASE action WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'merged' END"


def state():
    return F.when(F.col("action") == "error", "failed").when(F.col("action") == "purchase", "merged")


RUNS = f"""SELECT resource_id AS run, coalesce(arg_max({STATE}, ts) FILTER ({STATE} IS NOT NULL), 'running') AS state, arg_max(action, ts) AS last_action,
    min(ts) AS started, max(ts) AS updated, count(*) AS events FROM audit GROUP BY resource_id"""


def runs(a):
    """Run states: the last terminal action decides, else the run is still running. One aggregate, combined before the shuffle."""
    return a.groupBy(F.col("resource_id").alias("run")).agg(
        F.coalesce(F.max_by(state(), F.when(state().isNotNull(), F.col("ts"))), F.lit("running")).alias("state"),
        F.max_by("action", "ts").alias("last_action"),
        F.min("ts").alias("started"),
        F.max("ts").alias("updated"),
        F.count("*").alias("events"),
    )


@query("d40_runs", audit=RUNS)
def d40(spark, d):
    return runs(audit(spark, d))


@query("d41_run_states", audit=f"SELECT state, count(*) AS n FROM ({RUNS}) GROUP BY state")
def d41(spark, d):
    return runs(audit(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


@query("d42_jobs", audit=f"SELECT tenant_id, resource_id AS job, coalesce(arg_max({STATE}, ts) FILTER ({STATE} IS NOT NULL), 'running') AS state, max(props) FILTER (action = 'error') AS error FROM audit GROUP BY 1, 2")
def d42(spark, d):
    return audit(spark, d).groupBy("tenant_id", F.col("resource_id").alias("job")).agg(
        F.coalesce(F.max_by(state(), F.when(state().isNotNull(), F.col("ts"))), F.lit("running")).alias("state"), F.max(F.when(F.col("action") == "error", F.col("props"))).alias("error")
    )


@query("d43_derive_state", audit=f"SELECT trace_id, coalesce(arg_max({STATE}, ts) FILTER ({STATE} IS NOT NULL), 'running') AS state FROM audit WHERE trace_id IS NOT NULL GROUP BY 1")
def d43(spark, d):
    return audit(spark, d).where("trace_id IS NOT NULL").groupBy("trace_id").agg(F.coalesce(F.max_by(state(), F.when(state().isNotNull(), F.col("ts"))), F.lit("running")).alias("state"))


@query("d39_governance", audit="SELECT resource_id AS run, round(coalesce(sum(cost) FILTER (action <> 'error'), 0), 4) AS tool_cost, count(*) FILTER (action = 'error') AS breaches, count(*) FILTER (resource_type = 'approval') AS approvals, coalesce(sum(cost), 0) > 500 AS over_cap FROM audit GROUP BY 1")
def d39(spark, d):
    err = F.col("action") == "error"
    return audit(spark, d).groupBy(F.col("resource_id").alias("run")).agg(
        F.round(F.coalesce(F.sum(F.when(~err, F.col("cost"))), F.lit(0.0)), 4).alias("tool_cost"),
        F.count_if(err).alias("breaches"),
        F.count_if(F.col("resource_type") == "approval").alias("approvals"),
        (F.coalesce(F.sum("cost"), F.lit(0.0)) > 500).alias("over_cap"),
    )


@query("d48_running_cost", audit="SELECT pk, resource_id, round(sum(greatest(cost, 0)) OVER (PARTITION BY resource_id ORDER BY ts, pk), 6) AS spent FROM audit")
def d48(spark, d):
    rows = audit(spark, d).select("pk", "resource_id", "ts", "cost")
    return running_sum(rows, "resource_id", ("ts", "pk"), F.greatest("cost", F.lit(0.0))).select("pk", "resource_id", F.round("total", 6).alias("spent"))


@query("t08_circuit_breaker", audit="SELECT pk, coalesce(sum(cost) OVER (PARTITION BY resource_id ORDER BY ts, pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 200 AS refused FROM audit")
def t08(spark, d):
    rows = audit(spark, d).select("pk", "resource_id", "ts", "cost")
    return running_sum(rows, "resource_id", ("ts", "pk"), F.col("cost"), before=True).select("pk", (F.round("total", 6) >= 200).alias("refused"))


@query("t02_tail_batch", audit="SELECT pk FROM audit WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND tenant_id = 't1' ORDER BY ts, pk LIMIT 200")
def t02(spark, d):
    return audit(spark, d).where("ts > TIMESTAMP_NTZ '2024-01-10 00:00:00' AND tenant_id = 't1'").orderBy("ts", "pk").limit(200).select("pk")


@query("k14_run_bundles", lists=("timeline",), audit="SELECT resource_id AS run, list(pk ORDER BY ts, pk) AS timeline FROM audit GROUP BY 1")
def k14(spark, d):
    timeline = F.transform(F.array_sort(F.collect_list(F.struct("ts", "pk"))), lambda x: x["pk"])
    return audit(spark, d).groupBy(F.col("resource_id").alias("run")).agg(timeline.alias("timeline"))


@query("k15_sse_frames", audit=f"SELECT pk, 'event: ' || {EVENT_TYPE} || chr(10) || 'id: ' || CAST(pk AS STRING) || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM audit")
def k15(spark, d):
    return audit(spark, d).select("pk", F.format_string("event: %s\nid: %d\ndata: %s\n\n", event_type(), F.col("pk"), F.col("props")).alias("frame"))


@query("j60_task_audit", audit="SELECT a.pk FROM audit a WHERE a.trace_id IN (SELECT trace_id FROM audit WHERE resource_id = 'r42') OR (a.trace_id IS NULL AND a.resource_id = 'r42')")
def j60(spark, d):
    a = audit(spark, d)
    traces = a.where("resource_id = 'r42' AND trace_id IS NOT NULL").select("trace_id").distinct()
    return a.join(traces, "trace_id", "left_semi").select("pk").unionByName(a.where("resource_id = 'r42' AND trace_id IS NULL").select("pk"))


@query("m07_episodes", audit="SELECT DISTINCT action AS kind, actor AS tool, props AS reason FROM audit WHERE action = 'error' OR resource_type = 'approval'")
def m07(spark, d):
    return audit(spark, d).where("action = 'error' OR resource_type = 'approval'").select(F.col("action").alias("kind"), F.col("actor").alias("tool"), F.col("props").alias("reason")).distinct()


@query("m15_first_decision", audit="SELECT resource_id, arg_min(action, ts) AS decision, min(ts) AS decided_at FROM audit WHERE action IN ('purchase', 'error', 'signup') GROUP BY 1")
def m15(spark, d):
    rows = audit(spark, d).where(F.col("action").isin("purchase", "error", "signup"))
    return rows.groupBy("resource_id").agg(F.min_by("action", "ts").alias("decision"), F.min("ts").alias("decided_at"))


@query("m17_last_confirm", audit="SELECT actor AS node, arg_max(resource_id, pk) AS ref FROM audit WHERE action = 'purchase' GROUP BY 1")
def m17(spark, d):
    return audit(spark, d).where("action = 'purchase'").groupBy(F.col("actor").alias("node")).agg(F.max_by("resource_id", "pk").alias("ref"))


@query("m18_rejects", audit="SELECT actor AS node, count(*) FILTER (action = 'purchase') AS confirms, count(*) FILTER (action = 'error') AS rejects FROM audit GROUP BY 1")
def m18(spark, d):
    return audit(spark, d).groupBy(F.col("actor").alias("node")).agg(F.count_if(F.col("action") == "purchase").alias("confirms"), F.count_if(F.col("action") == "error").alias("rejects"))


@query("m13_append", audit="SELECT count(*) AS n, count(DISTINCT pk) AS distinct_n FROM (SELECT pk FROM audit UNION ALL SELECT pk + 1000000000 FROM audit WHERE action = 'error')")
def m13(spark, d):
    a = audit(spark, d)
    both = a.select("pk").unionByName(a.where("action = 'error'").select((F.col("pk") + 1000000000).alias("pk")))
    return both.agg(F.count("*").alias("n"), F.count_distinct("pk").alias("distinct_n"))


@query("d34_tally", audit="SELECT coalesce(nullif(trace_id, ''), 'unknown') AS value, count(*) AS n FROM audit GROUP BY 1")
def d34(spark, d):
    return audit(spark, d).groupBy(F.coalesce(F.nullif("trace_id", F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


@query("d36_run_metrics", audit=f"SELECT tenant, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'merged') AS merged, count(*) FILTER (state = 'running') AS running FROM (SELECT tenant_id AS tenant, resource_id, coalesce(arg_max({STATE}, ts) FILTER ({STATE} IS NOT NULL), 'running') AS state FROM audit GROUP BY 1, 2) GROUP BY 1")
def d36(spark, d):
    per = d42(spark, d).select(F.col("tenant_id").alias("tenant"), "state")
    return per.groupBy("tenant").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("failed", "merged", "running")])


@query("d37_stage_usage", "SELECT role AS stage, sum(length(text))::BIGINT AS tokens, count(*) AS calls, count(DISTINCT conv_id) AS convs FROM conversations GROUP BY 1")
def d37(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("role").alias("stage")).agg(F.sum(F.length("text").cast("long")).alias("tokens"), F.count("*").alias("calls"), F.count_distinct("conv_id").alias("convs"))


@query("d38_stage_total", "SELECT coalesce(role, 'total') AS stage, sum(length(text))::BIGINT AS tokens FROM conversations GROUP BY ROLLUP (role)")
def d38(spark, d):
    return table(spark, d, "conversations").rollup("role").agg(F.sum(F.length("text").cast("long")).alias("tokens")).select(F.coalesce("role", F.lit("total")).alias("stage"), "tokens")


@query("k13_run_records", lists=("observations",), sql="SELECT conv_id, list(left(text, 2000) ORDER BY turn) AS observations, count(*) AS steps FROM conversations GROUP BY 1")
def k13(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.left("text", F.lit(2000)).alias("o")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["o"]).alias("observations"), F.count("*").alias("steps"))


# --- versioned rows: orders as versions of a customer's record


VERSIONS = "SELECT o_custkey AS id, '0.' || CAST(o_orderkey % 13 AS STRING) AS version, o_orderstatus AS status, o_orderkey AS pk, string_split(o_orderpriority, '-') AS tags FROM orders"


def versions(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), F.concat(F.lit("0."), (F.col("o_orderkey") % 13).cast("string")).alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("pk"), F.split("o_orderpriority", "-").alias("tags")
    )


@query("w01_keyset_page", f"SELECT pk, id FROM ({VERSIONS}) WHERE pk < 1200 AND status = 'O' AND list_contains(tags, 'URGENT') ORDER BY pk DESC LIMIT 21")
def w01(spark, d):
    return versions(spark, d).where("pk < 1200 AND status = 'O'").where(F.array_contains("tags", "URGENT")).orderBy(F.desc("pk")).limit(21).select("pk", "id")


@query("w02_latest_published", f"SELECT id, max(version) AS version FROM ({VERSIONS}) WHERE status = 'F' GROUP BY id")
def w02(spark, d):
    return versions(spark, d).where("status = 'F'").groupBy("id").agg(F.max("version").alias("version"))


@query("w02b_latest_semantic", f"SELECT id, '0.' || CAST(max(CAST(string_split(version, '.')[2] AS INT)) AS STRING) AS version FROM ({VERSIONS}) WHERE status = 'F' GROUP BY id")
def w02b(spark, d):
    number = F.split("version", r"\.")[1].cast("int")
    return versions(spark, d).where("status = 'F'").groupBy("id").agg(F.max_by("version", number).alias("version"))


@query("w03_versions_in_order", lists=("versions",), sql=f"SELECT id, list(version ORDER BY version, pk) AS versions FROM ({VERSIONS}) GROUP BY id")
def w03(spark, d):
    return versions(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("version", "pk"))), lambda x: x["version"]).alias("versions"))


@query("w04_previous_hash", "SELECT o_orderkey, lag(sha256(CAST(o_orderkey AS STRING) || o_orderstatus)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before_hash FROM orders")
def w04(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag(F.sha2(F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus"), 256)).over(order).alias("before_hash"))


@query("w05_row_hash", """SELECT o_orderkey, sha256('{"custkey":' || CAST(o_custkey AS STRING) || ',"note":null,"status":"' || o_orderstatus || '"}') AS h FROM orders""")
def w05(spark, d):
    row = F.struct(F.col("o_custkey").alias("custkey"), F.lit(None).cast("string").alias("note"), F.col("o_orderstatus").alias("status"))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("h"))


@query("w06_page_slugs", "SELECT p_name, slug || CASE WHEN rn > 1 THEN '-' || left(sha1(p_name), 6) ELSE '' END AS slug FROM (SELECT p_name, split_part(p_name, ' ', 1) AS slug, row_number() OVER (PARTITION BY lower(split_part(p_name, ' ', 1)) ORDER BY p_name) AS rn FROM (SELECT DISTINCT p_name FROM part))")
def w06(spark, d):
    names = table(spark, d, "part").select("p_name").distinct().withColumn("slug", F.substring_index("p_name", " ", 1))
    rn = F.row_number().over(Window.partitionBy(F.lower("slug")).orderBy("p_name"))
    return names.withColumn("rn", rn).select("p_name", F.concat("slug", F.when(F.col("rn") > 1, F.concat(F.lit("-"), F.left(F.sha1("p_name"), F.lit(6)))).otherwise("")).alias("slug"))


@query("w08_pick_claim", "SELECT l_orderkey, arg_min(l_linenumber, sha256(CAST(l_linenumber AS STRING) || '::' || CAST(l_orderkey AS STRING))) AS pick FROM lineitem GROUP BY 1")
def w08(spark, d):
    key = F.sha2(F.concat_ws("::", F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")), 256)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", key).alias("pick"))


@query("w21_worst_severity", "SELECT user_id, arg_max(event_type, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END * 10 + length(event_type)) AS worst FROM events GROUP BY 1")
def w21(spark, d):
    rank = F.coalesce(F.create_map(*[F.lit(x) for x in ("error", 3, "purchase", 2, "signup", 1)])[F.col("event_type")], F.lit(0)) * 10 + F.length("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", rank).alias("worst"))


@query("f27_approved_skills", "SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0 AND s_acctbal >= 5000")
def f27(spark, d):
    return table(spark, d, "supplier").where((F.col("s_nationkey") % 2 == 0) & (F.col("s_acctbal") >= 5000)).select("s_suppkey")


@query("f33_candidates_with_tag", f"SELECT pk FROM ({VERSIONS}) WHERE status = 'O' AND list_contains(tags, 'HIGH')")
def f33(spark, d):
    return versions(spark, d).where("status = 'O'").where(F.array_contains("tags", "HIGH")).select("pk")


@query("f34_dispatch", "SELECT o_orderkey, CASE o_orderstatus || left(o_orderpriority, 1) WHEN 'F1' THEN 'escalate' WHEN 'F2' THEN 'retry' WHEN 'O1' THEN 'proceed' ELSE 'hold' END AS step FROM orders")
def f34(spark, d):
    rules = spark.createDataFrame([("F", "1", "escalate"), ("F", "2", "retry"), ("O", "1", "proceed")], "o_orderstatus string, level string, step string")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("level"))
    return rows.join(F.broadcast(rules), ["o_orderstatus", "level"], "left").select("o_orderkey", F.coalesce("step", F.lit("hold")).alias("step"))


@query("f18_capabilities", "SELECT p_partkey FROM part WHERE (p_size <= 20) AND p_brand IN ('Brand#2', 'Brand#17')")
def f18(spark, d):
    wanted = F.array(F.lit("Brand#2"), F.lit("Brand#17"))
    facet = F.lit(None).cast("string")
    rows = table(spark, d, "part").where(facet.isNull() | (F.col("p_type") == facet))
    return rows.where((F.col("p_size") <= 20) & F.arrays_overlap(F.array("p_brand"), wanted)).select("p_partkey")


@query("f24_gap_rules", "SELECT doc_id, 'text' AS field, 'min_length' AS rule FROM documents WHERE length(trim(text)) < 200 UNION ALL SELECT doc_id, 'lang', 'field_present' FROM documents WHERE coalesce(lang, '') = '' UNION ALL SELECT doc_id, 'lines', 'max_items' FROM documents WHERE len(string_split(text, chr(10))) > 60")
def f24(spark, d):
    rows = table(spark, d, "documents")
    rules = F.array(
        F.when(F.length(F.trim("text")) < 200, F.struct(F.lit("text").alias("field"), F.lit("min_length").alias("rule"))),
        F.when(F.coalesce("lang", F.lit("")) == "", F.struct(F.lit("lang").alias("field"), F.lit("field_present").alias("rule"))),
        F.when(F.size(F.split("text", "\n")) > 60, F.struct(F.lit("lines").alias("field"), F.lit("max_items").alias("rule"))),
    )
    return rows.select("doc_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("doc_id", "r.field", "r.rule")


# --- memory: documents with their labels as confidence


MEMORY = "SELECT d.doc_id AS pk, d.source AS repo, d.text AS statement, coalesce(l.quality, 0) * 0.5 + 0.3 AS confidence, d.doc_id % 7 AS hits FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def memory(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("pk"), F.col("source").alias("repo"), F.col("text").alias("statement"), (F.coalesce("quality", F.lit(0)) * 0.5 + 0.3).alias("confidence"), (F.col("doc_id") % 7).alias("hits"))


@query("w11_memory_search", f"SELECT pk, overlap FROM (SELECT pk, confidence, hits, len(list_intersect(list_distinct(string_split(lower(statement), ' ')), ['the', 'and', 'thing', 'ble'])) AS overlap FROM ({MEMORY}) WHERE repo IN ('src1', 'src2')) WHERE overlap > 0 ORDER BY overlap DESC, confidence DESC, hits DESC, pk LIMIT 20")
def w11(spark, d):
    wanted = F.array(*[F.lit(w) for w in ("the", "and", "thing", "ble")])
    rows = memory(spark, d).where(F.col("repo").isin("src1", "src2")).withColumn("overlap", F.size(F.array_intersect(F.split(F.lower("statement"), " "), wanted)).cast("long"))
    return rows.where("overlap > 0").orderBy(F.desc("overlap"), F.desc("confidence"), F.desc("hits"), "pk").limit(20).select("pk", "overlap")


@query("w20_memory_list", f"SELECT pk FROM ({MEMORY}) ORDER BY confidence DESC, pk DESC LIMIT 50")
def w20(spark, d):
    return memory(spark, d).orderBy(F.desc("confidence"), F.desc("pk")).limit(50).select("pk")


@query("m04_record_hit", f"SELECT pk, CASE WHEN pk % 10 = 3 THEN hits + 1 ELSE hits END AS hits FROM ({MEMORY})")
def m04(spark, d):
    return memory(spark, d).select("pk", F.when(F.col("pk") % 10 == 3, F.col("hits") + 1).otherwise(F.col("hits")).alias("hits"))


@query("m05_reinforce", f"SELECT pk, round(least(0.99, confidence + 0.1), 6) AS confidence FROM ({MEMORY}) WHERE hits >= 3")
def m05(spark, d):
    return memory(spark, d).where("hits >= 3").select("pk", F.round(F.least(F.lit(0.99), F.col("confidence") + 0.1), 6).alias("confidence"))


@query("m06_decay", f"SELECT count(*) FILTER (confidence - 0.2 >= 0.15) AS decayed, count(*) FILTER (confidence - 0.2 < 0.15) AS deleted FROM ({MEMORY}) WHERE hits = 0")
def m06(spark, d):
    left = F.col("confidence") - 0.2
    return memory(spark, d).where("hits = 0").agg(F.count_if(left >= 0.15).alias("decayed"), F.count_if(left < 0.15).alias("deleted"))


@query("m03_insert", f"SELECT repo, count(*) AS n FROM (SELECT repo FROM ({MEMORY}) UNION ALL SELECT 'new' FROM documents WHERE n_chars > 5000) GROUP BY 1")
def m03(spark, d):
    m = memory(spark, d)
    return m.select("repo").unionByName(table(spark, d, "documents").where("n_chars > 5000").select(F.lit("new").alias("repo"))).groupBy("repo").agg(F.count("*").alias("n"))


@query("m09_create_unique", f"SELECT count(*) AS created FROM (SELECT DISTINCT id, version FROM ({VERSIONS}) WHERE status = 'O' EXCEPT SELECT id, version FROM ({VERSIONS}) WHERE status = 'F')")
def m09(spark, d):
    v = versions(spark, d)
    new = v.where("status = 'O'").select("id", "version").distinct()
    return new.join(v.where("status = 'F'").select("id", "version"), ["id", "version"], "left_anti").agg(F.count("*").alias("created"))


@query("m10_lifecycle", f"SELECT pk, CASE WHEN pk % 5 = 0 AND status = 'O' THEN 'F' WHEN pk % 5 = 1 THEN 'D' ELSE status END AS status FROM ({VERSIONS})")
def m10(spark, d):
    """Publish drafts, deprecate, leave the rest: one rewrite of the snapshot (M10-M12)."""
    k = F.col("pk") % 5
    return versions(spark, d).select("pk", F.when((k == 0) & (F.col("status") == "O"), "F").when(k == 1, "D").otherwise(F.col("status")).alias("status"))


@query("d52_distinct_repos", "SELECT DISTINCT source AS repo FROM documents ORDER BY 1")
def d52(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("repo")).distinct().orderBy("repo")


# --- calibration and evaluation


CALIBRATION = "SELECT d.source AS id, d.lang AS version, least(d.n_chars, 10000) AS claimed, l.quality AS ok, l.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def calibration(spark, d):
    """Claims are counted in ten-thousandths, so that means are quotients of whole numbers."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("id"), F.col("lang").alias("version"), F.least(F.col("n_chars"), F.lit(10000)).alias("claimed"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("ok")).join(docs, "doc_id")


@query("d30_calibration", f"SELECT id, version, count(*) AS n, sum(ok) / count(*) AS pass_rate, sum(claimed) / (count(*) * 10000.0::DOUBLE) AS mean_claimed, (sum(claimed) - 10000 * sum(ok)) / (count(*) * 10000.0::DOUBLE) AS gap FROM ({CALIBRATION}) GROUP BY 1, 2")
def d30(spark, d):
    n, ok, claimed = F.count("*"), F.sum("ok"), F.sum("claimed")
    return calibration(spark, d).groupBy("id", "version").agg(
        n.alias("n"), (ok / n).alias("pass_rate"), (claimed / (n * F.lit(10000.0))).alias("mean_claimed"), ((claimed - 10000 * ok) / (n * F.lit(10000.0))).alias("gap")
    )


@query("d31_calibration_of_candidates", f"SELECT id, version, count(*) AS n FROM ({CALIBRATION}) WHERE (id, version) IN (('src1', 'en'), ('src2', 'de'), ('none', 'xx')) GROUP BY 1, 2")
def d31(spark, d):
    wanted = spark.createDataFrame([("src1", "en"), ("src2", "de"), ("none", "xx")], "id string, version string")
    return calibration(spark, d).join(F.broadcast(wanted), ["id", "version"], "left_semi").groupBy("id", "version").agg(F.count("*").alias("n"))


TASKS = "SELECT user_id AS task, count(*) AS repeats, count(*) FILTER (event_type IN ('purchase', 'click')) AS accepted, sum(value) AS cost FROM events GROUP BY 1"


def tasks(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("task")).agg(F.count("*").alias("repeats"), F.count_if(F.col("event_type").isin("purchase", "click")).alias("accepted"), F.sum("value").alias("cost"))


@query("d32_scorecard", f"SELECT sum(accepted)::BIGINT AS accepted, sum(repeats)::BIGINT AS repeats, round(sum(accepted) / sum(repeats), 6) AS acceptance_rate, count(*) FILTER (accepted > 0 AND accepted < repeats) AS flaky, round(sum(cost), 2) AS total_cost FROM ({TASKS})")
def d32(spark, d):
    return tasks(spark, d).agg(
        F.sum("accepted").alias("accepted"), F.sum("repeats").alias("repeats"), F.round(F.sum("accepted") / F.sum("repeats"), 6).alias("acceptance_rate"),
        F.count_if((F.col("accepted") > 0) & (F.col("accepted") < F.col("repeats"))).alias("flaky"), F.round(F.sum("cost"), 2).alias("total_cost"),
    )


@query("d33_flaky", f"SELECT task FROM ({TASKS}) WHERE accepted > 0 AND accepted < repeats")
def d33(spark, d):
    return tasks(spark, d).where("accepted > 0 AND accepted < repeats").select("task")


@query("d35_gate_score", "SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS good, count(*) FILTER (quality = 1 AND toxic = 1) AS false_accepts, count(*) FILTER (quality = 0 AND toxic = 0) AS false_refusals FROM labels")
def d35(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if((q == 1) & (t == 0)).alias("good"), F.count_if((q == 1) & (t == 1)).alias("false_accepts"), F.count_if((q == 0) & (t == 0)).alias("false_refusals"))


@query("d50_promotion", "SELECT category, t - b AS delta, round(t - b, 9) >= 0.01 AS promote FROM (SELECT event_type AS category, avg((user_id % 3 = 0)::INT) FILTER (event_id % 2 = 0) AS t, avg((user_id % 3 = 0)::INT) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1)".replace("t - b AS delta", "round(t - b, 9) AS delta"))
def d50(spark, d):
    hit = (F.col("user_id") % 3 == 0).cast("int")
    arm = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, hit))
    per = table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(arm(0).alias("t"), arm(1).alias("b"))
    delta = F.round(F.col("t") - F.col("b"), 9)
    return per.select("category", delta.alias("delta"), (delta >= 0.01).alias("promote"))


@query("d44_mode", "SELECT user_id, arg_min(event_type, CAST(-n AS STRING) || event_type) AS mode FROM (SELECT user_id, event_type, 1000000 - count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1".replace("CAST(-n AS STRING) || event_type", "CAST(n AS STRING) || event_type"))
def d44(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("mode"))


@query("d45_findings_by_entity", lists=("kinds",), sql="SELECT user_id AS entity, list_sort(list(DISTINCT event_type)) AS kinds, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1")
def d45(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("error", "purchase")).groupBy(F.col("user_id").alias("entity")).agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.count("*").alias("n"))


@query("d47_conventions", "SELECT source, avg((lang = 'en')::INT) >= 0.6 AS mostly_english, avg((n_chars > 1000)::INT) >= 0.6 AS mostly_long FROM documents GROUP BY 1")
def d47(spark, d):
    share = lambda p: F.avg(p.cast("int")) >= 0.6
    return table(spark, d, "documents").groupBy("source").agg(share(F.col("lang") == "en").alias("mostly_english"), share(F.col("n_chars") > 1000).alias("mostly_long"))


@query("d46_rate", "SELECT source, count(l.doc_id) / nullif(count(*) FILTER (d.lang = 'es'), 0) AS rate FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def d46(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.lit(1).alias("l"))
    rows = table(spark, d, "documents").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.try_divide(F.count("l"), F.count_if(F.col("lang") == "es")).alias("rate"))


@query("d53_combined_result", "SELECT conv_id, arg_max(role, CASE role WHEN 'system' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END) AS outcome, sum(length(text))::BIGINT AS cost FROM conversations GROUP BY 1")
def d53(spark, d):
    rank = F.when(F.col("role") == "system", 2).when(F.col("role") == "assistant", 1).otherwise(0)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", rank).alias("outcome"), F.sum(F.length("text").cast("long")).alias("cost"))


@query("d54_stop_at_first_fail", "SELECT conv_id, turn FROM (SELECT conv_id, turn, min(turn) FILTER (length(text) > 300) OVER (PARTITION BY conv_id) AS fail FROM conversations) WHERE fail IS NULL OR turn <= fail")
def d54(spark, d):
    rows = table(spark, d, "conversations")
    fails = rows.where(F.length("text") > 300).groupBy("conv_id").agg(F.min("turn").alias("fail"))
    return rows.join(fails, "conv_id", "left").where("fail IS NULL OR turn <= fail").select("conv_id", "turn")


@query("d55_merge_maps", lists=("merged",), sql="SELECT user_id, list_sort(list(event_type || '=' || CAST(last AS STRING))) AS merged FROM (SELECT user_id, event_type, arg_max(event_id, event_id) AS last FROM events GROUP BY 1, 2) GROUP BY 1")
def d55(spark, d):
    """Map union where the last write of a key wins."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("last").cast("string")))).alias("merged"))


@query("d56_append_lists", lists=("ids",), sql="SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1")
def d56(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))


@query("d57_set_once", "SELECT user_id, min(event_type) AS value, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY 1")
def d57(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_type").alias("value"), (F.count_distinct("event_type") > 1).alias("conflict"))


@query("d58_write_once_glossary", "SELECT event_type AS term, min(user_id) AS value, count(DISTINCT user_id) AS writers FROM events GROUP BY 1")
def d58(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("term")).agg(F.min("user_id").alias("value"), F.count_distinct("user_id").alias("writers"))


@query("d59_finding_counts", "SELECT event_id, coalesce(json_array_length(json_extract('{\"results\":[' || CAST(user_id AS STRING) || ',2]}', '$.results')), 0)::BIGINT AS n FROM events")
def d59(spark, d):
    payload = F.concat(F.lit('{"results":['), F.col("user_id").cast("string"), F.lit(",2]}"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.json_array_length(F.get_json_object(payload, "$.results")), F.lit(0)).cast("long").alias("n"))


@query("d49_coverage_record", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS attributed, count(*) FILTER (quality = 0) AS unattributed, count(DISTINCT quality) AS kinds FROM labels")
def d49(spark, d):
    return table(spark, d, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("attributed"), F.count_if(F.col("quality") == 0).alias("unattributed"), F.count_distinct("quality").alias("kinds"))


# --- evaluation of predicted against labelled sets: two rules' documents


EXPECTED = "SELECT lang AS kind, doc_id FROM documents WHERE doc_id % 3 = 0"
EMITTED = "SELECT lang AS kind, doc_id FROM documents WHERE doc_id % 2 = 0 AND n_chars > 300"


def sides(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("kind"), "doc_id", "n_chars", "source")
    return docs.where("doc_id % 3 = 0"), docs.where("doc_id % 2 = 0 AND n_chars > 300")


KINDS = f"SELECT coalesce(e.kind, m.kind) AS kind, count(e.doc_id) AS expected, count(m.doc_id) AS emitted, count(*) FILTER (e.doc_id IS NOT NULL AND m.doc_id IS NOT NULL) AS matched FROM ({EXPECTED}) e FULL JOIN ({EMITTED}) m ON e.doc_id = m.doc_id GROUP BY 1"


def scored(spark, d):
    expected, emitted = sides(spark, d)
    marks = expected.select("kind", "doc_id", F.lit(1).alias("e"), F.lit(0).alias("m")).unionByName(emitted.select("kind", "doc_id", F.lit(0).alias("e"), F.lit(1).alias("m")))
    per = marks.groupBy("kind", "doc_id").agg(F.max("e").alias("e"), F.max("m").alias("m"))
    return per.groupBy("kind").agg(F.sum("e").cast("long").alias("expected"), F.sum("m").cast("long").alias("emitted"), F.count_if((F.col("e") == 1) & (F.col("m") == 1)).alias("matched"))


@query("d19_kind_scores", KINDS)
def d19(spark, d):
    return scored(spark, d)


@query("d20_case_sets", f"SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM ({EXPECTED}) EXCEPT SELECT doc_id FROM ({EMITTED})) UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM ({EMITTED}) EXCEPT SELECT doc_id FROM ({EXPECTED}))")
def d20(spark, d):
    expected, emitted = sides(spark, d)
    missing = expected.join(emitted.select("doc_id"), "doc_id", "left_anti").select(F.lit("missing").alias("side"), "doc_id")
    return missing.unionByName(emitted.join(expected.select("doc_id"), "doc_id", "left_anti").select(F.lit("unlabelled").alias("side"), "doc_id"))


@query("d22_totals", f"SELECT coalesce(kind, 'all') AS kind, sum(expected)::BIGINT AS expected, sum(emitted)::BIGINT AS emitted, sum(matched)::BIGINT AS matched FROM ({KINDS}) GROUP BY ROLLUP (kind)")
def d22(spark, d):
    return scored(spark, d).rollup("kind").agg(*[F.sum(c).alias(c) for c in ("expected", "emitted", "matched")]).withColumn("kind", F.coalesce("kind", F.lit("all")))


@query("d23_precision_recall", f"SELECT kind, matched / nullif(emitted, 0) AS precision, matched / nullif(expected, 0) AS recall FROM ({KINDS})")
def d23(spark, d):
    return scored(spark, d).select("kind", F.try_divide("matched", "emitted").alias("precision"), F.try_divide("matched", "expected").alias("recall"))


@query("d29_f1", f"SELECT kind, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM (SELECT kind, coalesce(matched / nullif(emitted, 0), 1.0) AS p, coalesce(matched / nullif(expected, 0), 1.0) AS r FROM ({KINDS}))")
def d29(spark, d):
    p, r = F.coalesce(F.try_divide("matched", "emitted"), F.lit(1.0)), F.coalesce(F.try_divide("matched", "expected"), F.lit(1.0))
    return scored(spark, d).select("kind", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


@query("d21_corpus_scores", f"SELECT e.source AS language, count(*) AS n FROM (SELECT * FROM documents WHERE doc_id % 3 = 0) e WHERE e.source IN (SELECT source FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def d21(spark, d):
    expected, emitted = sides(spark, d)
    available = table(spark, d, "documents").where("doc_id % 2 = 0").select("source").distinct()
    return expected.join(available, "source", "left_semi").groupBy(F.col("source").alias("language")).agg(F.count("*").alias("n"))


PARITY = "SELECT l_suppkey AS file, count(*) FILTER (l_returnflag = 'R') AS declared, count(*) FILTER (l_returnflag = 'A') AS in_graph FROM lineitem GROUP BY 1"


def parity(spark, d):
    flag = lambda x: F.count_if(F.col("l_returnflag") == x)
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(flag("R").alias("declared"), flag("A").alias("in_graph"))


@query("d18_source_parity", PARITY)
def d18(spark, d):
    return parity(spark, d)


@query("d24_shortfall", f"SELECT sum(greatest(0, declared - in_graph))::BIGINT AS shortfall, sum(greatest(0, in_graph - declared))::BIGINT AS surplus FROM ({PARITY})")
def d24(spark, d):
    """Shortfall and surplus (D24, D25)."""
    a, b = F.col("declared"), F.col("in_graph")
    return parity(spark, d).agg(F.sum(F.greatest(F.lit(0), a - b)).alias("shortfall"), F.sum(F.greatest(F.lit(0), b - a)).alias("surplus"))


@query("c05_parity_gaps", f"SELECT file, declared - in_graph AS shortfall FROM ({PARITY}) WHERE declared > in_graph")
def c05(spark, d):
    return parity(spark, d).where("declared > in_graph").select("file", (F.col("declared") - F.col("in_graph")).alias("shortfall"))


BOARD = "SELECT l_suppkey % 20 AS lang, count(*) AS emitted, count(*) FILTER (l_discount > 0.02) AS matched FROM lineitem WHERE l_linenumber {} GROUP BY 1"


def board(spark, d, part):
    return table(spark, d, "lineitem").where(part).groupBy((F.col("l_suppkey") % 20).alias("lang")).agg(F.count("*").alias("emitted"), F.count_if(F.col("l_discount") > 0.02).alias("matched"))


@query("c18_regressions", f"SELECT b.lang FROM ({BOARD.format('<= 3')}) b LEFT JOIN ({BOARD.format('> 3')}) c ON c.lang = b.lang WHERE c.lang IS NULL OR c.matched * b.emitted < b.matched * c.emitted")
def c18(spark, d):
    """Drops in an exact ratio: cross products of counts, never quotients."""
    b = board(spark, d, "l_linenumber <= 3").selectExpr("lang", "emitted AS be", "matched AS bm")
    c = board(spark, d, "l_linenumber > 3").selectExpr("lang", "emitted AS ce", "matched AS cm")
    return b.join(c, "lang", "left").where("ce IS NULL OR cm * be < bm * ce").select("lang")


@query("c19_improvements", f"SELECT b.lang FROM ({BOARD.format('<= 3')}) b JOIN ({BOARD.format('> 3')}) c ON c.lang = b.lang WHERE c.matched * b.emitted > b.matched * c.emitted")
def c19(spark, d):
    b = board(spark, d, "l_linenumber <= 3").selectExpr("lang", "emitted AS be", "matched AS bm")
    c = board(spark, d, "l_linenumber > 3").selectExpr("lang", "emitted AS ce", "matched AS cm")
    return b.join(c, "lang").where("cm * be > bm * ce").select("lang")


@query("d27_observations", "SELECT count(*) AS observed, count(*) FILTER (known) AS matched, count(*) FILTER (NOT known) AS missing FROM (SELECT DISTINCT l_suppkey, l_partkey, (l_suppkey, l_partkey) IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber > 2) AS known FROM lineitem WHERE l_linenumber <= 2)")
def d27(spark, d):
    li = table(spark, d, "lineitem")
    seen = li.where("l_linenumber <= 2").select("l_suppkey", "l_partkey").distinct()
    known = li.where("l_linenumber > 2").select("l_suppkey", "l_partkey", F.lit(1).alias("k")).distinct()
    return seen.join(known, ["l_suppkey", "l_partkey"], "left").agg(F.count("*").alias("observed"), F.count("k").alias("matched"), F.count_if(F.col("k").isNull()).alias("missing"))


@query("d28_mapping_precision", "SELECT count(*) FILTER (best = gold) AS tp, count(*) FILTER (best <> gold) AS fp, count(*) FILTER (best IS NULL) AS fn FROM (SELECT l_orderkey, max(l_partkey) FILTER (rn = 1) AS best, min(l_partkey) AS gold FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey DESC) AS rn FROM lineitem WHERE l_quantity >= 10) GROUP BY 1)")
def d28(spark, d):
    best = table(spark, d, "lineitem").where("l_quantity >= 10").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_quantity", -F.col("l_linenumber"), "l_partkey")).alias("best"), F.min("l_partkey").alias("gold"))
    return best.agg(F.count_if(F.col("best") == F.col("gold")).alias("tp"), F.count_if(F.col("best") != F.col("gold")).alias("fp"), F.count_if(F.col("best").isNull()).alias("fn"))


@query("d26_scoreboard", f"""SELECT '{{"kind":"' || kind || '","expected":' || CAST(expected AS STRING) || ',"emitted":' || CAST(emitted AS STRING) || ',"matched":' || CAST(matched AS STRING) || '}}' AS row FROM ({KINDS})""")
def d26(spark, d):
    return scored(spark, d).select(F.to_json(F.struct("kind", "expected", "emitted", "matched")).alias("row"))


# --- lineage: order -> customer -> nation -> supplier


LINEAGE = "SELECT c.c_custkey, n.n_name AS iri, count(o.o_orderkey) AS shipments, coalesce(round(sum(o.o_totalprice), 2), 0) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2"


def lineage(spark, d):
    """Entities with their reference and what hangs on them; children are aggregated before they are joined."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("shipments"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    named = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("iri")), "n_nationkey")
    return named.join(orders, "c_custkey", "left").select("c_custkey", "iri", F.coalesce("shipments", F.lit(0)).alias("shipments"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("j47_lineage_of_entities", LINEAGE)
def j47(spark, d):
    return lineage(spark, d)


@query("j48_lineage_of_iri", f"SELECT * FROM ({LINEAGE}) WHERE iri = 'NATION_3' ORDER BY c_custkey")
def j48(spark, d):
    return lineage(spark, d).where("iri = 'NATION_3'").orderBy("c_custkey")


@query("j49_lineage_of_node", f"SELECT s.s_suppkey AS node, l.c_custkey FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN ({LINEAGE}) l ON l.iri = n.n_name WHERE s.s_suppkey = 3")
def j49(spark, d):
    nodes = table(spark, d, "supplier").where("s_suppkey = 3").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("node"), F.col("n_name").alias("iri"))
    return nodes.join(lineage(spark, d).select("iri", "c_custkey"), "iri").select("node", "c_custkey")


@query("j50_lineage_of_trace", f"SELECT o.o_orderkey AS trace, l.iri, l.shipments FROM orders o JOIN ({LINEAGE}) l ON l.c_custkey = o.o_custkey")
def j50(spark, d):
    traces = table(spark, d, "orders").select(F.col("o_orderkey").alias("trace"), F.col("o_custkey").alias("c_custkey"))
    return traces.join(lineage(spark, d), "c_custkey").select("trace", "iri", "shipments")


@query("j51_remediations", "SELECT n.n_name AS iri, count(DISTINCT c.c_custkey) FILTER (c.c_acctbal < 0) AS findings, count(DISTINCT s.s_suppkey) AS scope FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1")
def j51(spark, d):
    bad = table(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("findings"))
    scope = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("scope"))
    rows = table(spark, d, "nation").join(bad, "n_nationkey", "left").join(scope, "n_nationkey", "left").fillna(0, ["findings", "scope"])
    return rows.select(F.col("n_name").alias("iri"), "findings", "scope")


@query("j52_infer_iris", "SELECT c.c_custkey, n.n_nationkey FROM customer c JOIN nation n ON replace(n.n_name, '_', '') = 'NATION' || CAST(c.c_custkey % 40 AS STRING)")
def j52(spark, d):
    keys = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("NATION"), (F.col("c_custkey") % 40).cast("string")).alias("bare"))
    return keys.join(table(spark, d, "nation").select("n_nationkey", F.replace("n_name", F.lit("_"), F.lit("")).alias("bare")), "bare").select("c_custkey", "n_nationkey")


@query("j53_dependencies", "SELECT o.o_orderkey, coalesce(a.p_partkey, b.p_partkey) AS target FROM orders o LEFT JOIN part a ON a.p_partkey = o.o_custkey * 2 LEFT JOIN (SELECT lower(p_name) AS title, min(p_partkey) AS p_partkey FROM part GROUP BY 1) b ON b.title = 'red widget' AND a.p_partkey IS NULL WHERE coalesce(a.p_partkey, b.p_partkey) <> o.o_orderkey")
def j53(spark, d):
    part = table(spark, d, "part")
    by_id = part.select(F.col("p_partkey").alias("a"))
    by_title = part.groupBy(F.lower("p_name").alias("title")).agg(F.min("p_partkey").alias("b"))
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("ref"), F.lit("red widget").alias("title"))
    joined = rows.join(by_id, F.col("ref") == F.col("a"), "left").join(by_title, "title", "left")
    return joined.select("o_orderkey", F.coalesce("a", "b").alias("target")).where("target <> o_orderkey")


@query("j65_glossary_precedence", "SELECT term, arg_min(v, p) AS value, min(p) AS source FROM (SELECT p_name AS term, 1 AS p, min(p_partkey) AS v FROM part WHERE p_size < 10 GROUP BY 1 UNION ALL SELECT p_name, 2, min(p_partkey) FROM part WHERE p_size < 30 GROUP BY 1 UNION ALL SELECT p_name, 3, min(p_partkey) FROM part GROUP BY 1) GROUP BY 1")
def j65(spark, d):
    part = table(spark, d, "part").select(F.col("p_name").alias("term"), "p_partkey", "p_size")
    p = F.when(F.col("p_size") < 10, 1).when(F.col("p_size") < 30, 2).otherwise(3)
    return part.groupBy("term").agg(F.min_by("p_partkey", F.struct(p, "p_partkey")).alias("value"), F.min(p).alias("source"))


@query("j64_glossary_terms", "SELECT DISTINCT d.doc_id, t.term FROM documents d JOIN (SELECT unnest(['the', 'thing', 'heit', 'ción', 'eau']) AS term) t ON contains(lower(d.text), t.term)")
def j64(spark, d):
    terms = ["the", "thing", "heit", "ción", "eau"]
    low = F.lower("text")
    hits = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return table(spark, d, "documents").select("doc_id", F.explode(hits).alias("term"))


@query("j67_tool_contracts", "SELECT coalesce(c.k, s.k) AS key, CASE WHEN c.k IS NULL THEN 'unmatched' WHEN s.k IS NULL THEN 'unhandled' ELSE 'matched' END AS status FROM (SELECT DISTINCT c_nationkey * 2 AS k FROM customer) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON s.k = c.k")
def j67(spark, d):
    handlers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.lit(1).alias("h"), F.lit(0).alias("p"))
    published = table(spark, d, "customer").select((F.col("c_nationkey") * 2).alias("key"), F.lit(0).alias("h"), F.lit(1).alias("p"))
    per = handlers.unionByName(published).groupBy("key").agg(F.max("h").alias("h"), F.max("p").alias("p"))
    return per.select("key", F.when(F.col("p") == 0, "unmatched").when(F.col("h") == 0, "unhandled").otherwise("matched").alias("status"))


@query("c09_page_sets", "SELECT coalesce(a.k, b.k) AS page, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'orphaned' WHEN a.v <> b.v THEN 'stale' ELSE 'current' END AS status FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, p_size % 40 AS v FROM part WHERE p_partkey % 4 <> 0) b ON a.k = b.k")
def c09(spark, d):
    part = table(spark, d, "part")
    a = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("page"), F.col("p_size").alias("a"))
    b = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("page"), (F.col("p_size") % 40).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphaned").when(F.col("a") != F.col("b"), "stale").otherwise("current")
    return a.join(b, "page", "full_outer").select("page", status.alias("status"))


@query("c10_unregistered_tools", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def c10(spark, d):
    return table(spark, d, "lineitem").select("l_partkey").distinct().join(table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")


@query("c13_metric_claims", "SELECT o_orderkey, CASE WHEN s IS NULL THEN 'missing' WHEN abs(o_totalprice - s) > 0.1 * abs(s) THEN 'out of tolerance' ELSE 'ok' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def c13(spark, d):
    actual = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    off = F.abs(F.col("o_totalprice") - F.col("s")) > 0.1 * F.abs("s")
    return table(spark, d, "orders").join(actual, "o_orderkey", "left").select("o_orderkey", F.when(F.col("s").isNull(), "missing").when(off, "out of tolerance").otherwise("ok").alias("status"))


@query("c22_post_conditions", "SELECT o_orderkey, 'price' AS rule FROM orders WHERE NOT coalesce(o_totalprice > 100000, false) UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE NOT coalesce(o_orderstatus IN ('O', 'F'), false)")
def c22(spark, d):
    from ..functions.text import predicate

    fails = F.array(F.when(~predicate("gt", F.col("o_totalprice"), 100000), F.lit("price")), F.when(~predicate("in", F.col("o_orderstatus"), ["O", "F"]), F.lit("status")))
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.filter(fails, lambda x: x.isNotNull())).alias("rule"))


@query("c21_classification", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'fail' WHEN 'MACHINERY' THEN 'pass' WHEN 'HOUSEHOLD' THEN 'pass' ELSE 'warn' END AS verdict FROM customer")
def c21(spark, d):
    level = F.create_map(*[F.lit(x) for x in ("BUILDING", 3, "MACHINERY", 1, "HOUSEHOLD", 0)])[F.col("c_mktsegment")]
    return table(spark, d, "customer").select("c_custkey", F.when(level.isNull(), "warn").when(level > 1, "fail").otherwise("pass").alias("verdict"))


@query("c23_unsupported_claims", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def c23(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("c12_prior_runs", "SELECT o_custkey, min(o_orderkey) AS run FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 GROUP BY 1")
def c12(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").groupBy("o_custkey").agg(F.min("o_orderkey").alias("run"))


@query("c11_countable_claims", "SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS claimed, n AS actual, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) <= n AS holds FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def c11(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("actual"))
    claimed = F.regexp_extract("p_brand", "[0-9]+", 0).cast("long")
    return table(spark, d, "part").join(n, "p_partkey").select("p_partkey", claimed.alias("claimed"), "actual", (claimed <= F.col("actual")).alias("holds"))


@query("c14_glossary_conflicts", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'the [a-z]*tion ') AND lang <> 'en'")
def c14(spark, d):
    return table(spark, d, "documents").where(F.rlike(F.lower("text"), F.lit("the [a-z]*tion ")) & (F.col("lang") != "en")).select("doc_id")


@query("u02_merge_criteria", "SELECT DISTINCT k FROM (SELECT lower(trim(p_name)) AS k FROM part WHERE p_size < 25) WHERE k NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_size >= 25)")
def u02(spark, d):
    key = F.lower(F.trim("p_name")).alias("k")
    part = table(spark, d, "part")
    return part.where("p_size < 25").select(key).distinct().join(part.where("p_size >= 25").select(key), "k", "left_anti")


@query("u03_capability_plan", lists=("brands",), sql="SELECT p_type AS kind, list_sort(list(DISTINCT p_brand)) AS brands FROM part WHERE p_size <= 10 GROUP BY 1")
def u03(spark, d):
    return table(spark, d, "part").where("p_size <= 10").groupBy(F.col("p_type").alias("kind")).agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))


@query("u04_describe", lists=("described",), sql="SELECT list_sort(list(DISTINCT p_brand || ' ' || p_type)) AS described FROM part")
def u04(spark, d):
    return table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("x")).distinct().agg(F.array_sort(F.collect_list("x")).alias("described"))


@query("w19_recommendations", "SELECT s_suppkey, 'low balance' AS advice FROM supplier WHERE s_acctbal < 1000 UNION ALL SELECT s_suppkey, 'review nation' FROM supplier WHERE s_nationkey IN (3, 7)")
def w19(spark, d):
    rules = F.array(F.when(F.col("s_acctbal") < 1000, F.lit("low balance")), F.when(F.col("s_nationkey").isin(3, 7), F.lit("review nation")))
    return table(spark, d, "supplier").select("s_suppkey", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("advice"))
