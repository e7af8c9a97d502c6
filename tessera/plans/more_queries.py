"""Queries of smaller sources, mutations and the extension surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import code
from ..sources.fact_tables import facts
from .event_queries import MEMORY, VERSIONS, memory, versions
from .io_queries import sql_files, table
from .registry import query


@query("s15_statement_tables", "SELECT n_nationkey, 'log' AS writes, 't' || CAST(n_nationkey AS STRING) AS reads FROM nation")
def s15(spark, d):
    """Tables that a statement writes, and those it reads beside them."""
    name = r"([A-Za-z_]\w*)"
    s = F.concat(F.lit("INSERT INTO log SELECT id FROM t"), F.col("n_nationkey").cast("string"), F.lit(" JOIN log ON 1 = 1"))
    writes = F.regexp_extract_all(s, F.lit(r"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+" + name), F.lit(1))
    every = F.regexp_extract_all(s, F.lit(r"(?i)\b(?:FROM|JOIN|USING)\s+" + name), F.lit(1))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(writes, ",").alias("writes"), F.array_join(F.array_except(every, writes), ",").alias("reads"))


@query("s19_decode", "SELECT n_nationkey, n_name AS text FROM nation")
def s19(spark, d):
    k = F.col("n_nationkey") % 3
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("n_name", "UTF-16LE"))
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("n_name", "UTF-8"))
    content = F.when(k == 0, wide).when(k == 1, marked).otherwise(F.encode("n_name", "UTF-8"))
    return table(spark, d, "nation").select("n_nationkey", code.decode(content).alias("text"))


@query("s20_batches", "SELECT n_nationkey, 2::BIGINT AS batches FROM nation")
def s20(spark, d):
    text = F.concat(F.lit("SELECT 1\nGO\nSELECT "), F.col("n_nationkey").cast("string"), F.lit("\n go ; \n\n"))
    parts = F.filter(F.split(text, r"(?im)^[ \t]*GO[ \t]*;?[ \t]*$"), lambda x: F.length(F.trim(F.regexp_replace(x, r"\s+", ""))) > 0)
    return table(spark, d, "nation").select("n_nationkey", F.size(parts).cast("long").alias("batches"))


@query("s21_dialects", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' END AS dialect FROM nation")
def s21(spark, d):
    """The dialect with most marks; none where there are no marks, the first in order on ties."""
    k = F.col("n_nationkey") % 3
    text = F.when(k == 0, "CREATE TABLE t (a SERIAL, b JSONB)").when(k == 1, "CREATE TABLE `t` (`a` INT AUTO_INCREMENT)").otherwise("SELECT 1")
    scored = F.array(*[F.struct(F.regexp_count(text, F.lit(f"(?i){p}")).alias("hits"), F.lit(-i).alias("rank"), F.lit(n).alias("name")) for i, (n, p) in enumerate(code.DIALECTS.items())])
    best = F.array_max(scored)
    return table(spark, d, "nation").select("n_nationkey", F.when(best["hits"] > 0, best["name"]).alias("dialect"))


@query("s22_statement_lines", "SELECT 'n' || CAST(n_nationkey AS STRING) AS f, unnest([2, 3, 4, 5, 6]) AS line FROM nation")
def s22(spark, d):
    def lines(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p.rsplit("/", 1)[1][:-4], line) for p, c in zip(pdf["path"], pdf["content"]) for line, _ in code.statements(c)]
            yield pd.DataFrame(rows, columns=["f", "line"])

    return sql_files(spark, d).mapInPandas(lines, "f string, line int")


@query("s26_front_matter", "SELECT n_nationkey, n_name || ' ' || CAST(n_regionkey AS STRING) AS prose FROM nation")
def s26(spark, d):
    page = F.concat(F.lit("---\ntitle: "), "n_name", F.lit("\norder: "), F.col("n_regionkey").cast("string"), F.lit("\n---\nbody"))
    block = F.regexp_extract(page, r"(?s)^---\n(.*?)\n---", 1)
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\w+:\s*", "")), " ").alias("prose"))


@query("s40_migration_files", graph="SELECT DISTINCT file FROM nodes WHERE regexp_matches(file, '(^|/)db/.*\\.sql$') ORDER BY file")
def s40(spark, d):
    return facts(spark, d).nodes.where(F.rlike("file", F.lit(r"(^|/)db/.*\.sql$"))).select("file").distinct().orderBy("file")


@query("s44_changed_files", """SELECT DISTINCT file FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40) o, LATERAL (
    SELECT 'db/o' || CAST(o.o_orderkey % 20 AS STRING) || '.sql' AS file UNION ALL SELECT 'src/parts/p' || CAST(l_partkey % 40 AS STRING) || '.py' FROM lineitem WHERE l_orderkey = o.o_orderkey) f""")
def s44(spark, d):
    """Files that the last 40 commits changed: an order is a commit, its lines are the files beside its own."""
    last = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(40).select("o_orderkey")  # the limit is the feature
    lines = table(spark, d, "lineitem").join(F.broadcast(last), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    own = last.select(F.concat(F.lit("db/o"), (F.col("o_orderkey") % 20).cast("string"), F.lit(".sql")).alias("file"))
    return own.unionByName(lines.select(F.concat(F.lit("src/parts/p"), (F.col("l_partkey") % 40).cast("string"), F.lit(".py")).alias("file"))).distinct()


@query("s49b_heading_lines", "SELECT doc_id, len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+\\.$')) AS headings FROM documents")
def s49b(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"(?m)^[A-Z][a-z]+\.$")).cast("long").alias("headings"))


@query("s54_metric_definition", f"SELECT id, arg_max(version, [x::INT FOR x IN string_split(version, '.')]) AS version FROM ({VERSIONS}) WHERE status = 'O' GROUP BY id")
def s54(spark, d):
    """The latest published version of each term, its parts compared as numbers."""
    return versions(spark, d).where("status = 'O'").groupBy("id").agg(F.max_by("version", F.split("version", r"\.").cast("array<int>")).alias("version"))


@query("s58_call_pairs", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'")
def s58(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("s61_findings", "SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'info' ELSE 'warning' END AS severity FROM events")
def s61(spark, d):
    payload = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("check"))).alias("results")))
    rows = table(spark, d, "events").select("event_id", F.explode(F.from_json(payload, "results array<struct<check:string>>")["results"]).alias("r"))
    level = F.create_map(*[F.lit(x) for x in ("error", "critical", "view", "info")])
    return rows.select("event_id", F.coalesce(level[F.col("r.check")], F.lit("warning")).alias("severity"))


@query("s63_infrastructure", "SELECT p_brand, string_agg(DISTINCT s, ',' ORDER BY s) AS signals FROM (SELECT p_brand, unnest(['red', 'ring', 'small']) AS s, p_name FROM part) WHERE contains(p_name, s) GROUP BY 1")
def s63(spark, d):
    hits = F.filter(F.array(*[F.when(F.contains("p_name", F.lit(s)), F.lit(s)) for s in ("red", "ring", "small")]), lambda x: x.isNotNull())
    rows = table(spark, d, "part").select("p_brand", F.explode(hits).alias("s"))
    return rows.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("signals"))


@query("s73_resolve_includes", graph="SELECT base, min(file) AS file FROM (SELECT DISTINCT file, list_extract(string_split(file, '/'), -1) AS base FROM nodes WHERE file IS NOT NULL) GROUP BY base HAVING count(*) = 1")
def s73(spark, d):
    """Basenames that one file only has, and that file (S73, S74)."""
    files = facts(spark, d).nodes.where("file IS NOT NULL").select("file").distinct()
    return files.groupBy(F.substring_index("file", "/", -1).alias("base")).agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n = 1").select("base", "file")


@query("s80_sibling_calls", graph="SELECT a.dst AS caller, b.dst AS callee FROM edges a JOIN edges b ON b.src = a.src AND b.kind = 'CONTAINS' JOIN edges c ON c.kind = 'CALLS' AND c.src = a.dst AND c.dst = b.dst WHERE a.kind = 'CONTAINS' GROUP BY 1, 2")
def s80(spark, d):
    e = facts(spark, d).edges
    owner = e.where("kind = 'CONTAINS'").select("src", "dst")
    calls = e.where("kind = 'CALLS'").select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct()
    return calls.join(owner.select(F.col("dst").alias("caller"), F.col("src").alias("o1")), "caller").join(owner.select(F.col("dst").alias("callee"), F.col("src").alias("o2")), "callee").where("o1 = o2").select("caller", "callee").distinct()


@query("s87_lenient_documents", "SELECT event_id, coalesce(json_extract_string(props, '$.title'), json_extract_string(props, '$.k'), 'untitled') AS title FROM events")
def s87(spark, d):
    v = F.parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.title", "string"), F.try_variant_get(v, "$.k", "string"), F.lit("untitled")).alias("title"))


@query("d51_ab_decision", """SELECT skill, base AS baseline_rate, treat AS treatment_rate, round(treat - base, 9) >= 0.01 AS promote FROM (
    SELECT o_orderpriority AS skill, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderstatus = 'F') / count(*) FILTER (o_orderkey % 2 = 0) AS base,
           count(*) FILTER (o_orderkey % 2 = 1 AND o_orderstatus = 'F') / count(*) FILTER (o_orderkey % 2 = 1) AS treat FROM orders GROUP BY 1)""")
def d51(spark, d):
    """Per skill the accepted share of both arms, and whether the treatment is ahead by the margin, float noise set aside."""
    rate = lambda arm: F.count_if((F.col("o_orderkey") % 2 == arm) & (F.col("o_orderstatus") == "F")) / F.count_if(F.col("o_orderkey") % 2 == arm)
    rates = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("skill")).agg(rate(0).alias("baseline_rate"), rate(1).alias("treatment_rate"))
    return rates.withColumn("promote", F.round(F.col("treatment_rate") - F.col("baseline_rate"), 9) >= 0.01)


@query("m02_apply_migrations", graph="SELECT file, count(*) AS n FROM (SELECT file, id FROM nodes WHERE file NOT LIKE 'db/%' UNION ALL SELECT 'folded', id FROM nodes WHERE kind = 'Entity') GROUP BY file")
def m02(spark, d):
    n = facts(spark, d).nodes
    kept = n.where("file NOT LIKE 'db/%'").select("file", "id")
    return kept.unionByName(n.where("kind = 'Entity'").select(F.lit("folded").alias("file"), "id")).groupBy("file").agg(F.count("*").alias("n"))


@query("m08b_statements", f"SELECT repo, count(DISTINCT lower(statement)) AS facts, count(*) AS episodes FROM ({MEMORY}) GROUP BY repo")
def m08b(spark, d):
    """Episodes per repository and what is left once equal statements reinforce one another."""
    return memory(spark, d).groupBy("repo").agg(F.count_distinct(F.lower("statement")).alias("facts"), F.count("*").alias("episodes"))


@query("m12_update_draft_only", f"SELECT pk, CASE WHEN status = 'O' THEN 'new' ELSE 'kept' END AS spec FROM ({VERSIONS})")
def m12(spark, d):
    return versions(spark, d).select("pk", F.when(F.col("status") == "O", "new").otherwise("kept").alias("spec"))


@query("m16_record_outcomes", "SELECT source, count(*) AS n FROM (SELECT d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id UNION ALL SELECT source FROM documents WHERE n_chars > 5000) GROUP BY 1")
def m16(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    known = table(spark, d, "labels").select("doc_id").join(docs, "doc_id").select("source")
    return known.unionByName(docs.where("n_chars > 5000").select("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("e07_rules_over_rows", "SELECT p_partkey, unnest(list_filter([CASE WHEN p_size < 10 THEN 'small' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END], lambda x: x IS NOT NULL)) AS rule FROM part")
def e07(spark, d):
    """A declared rule table turned into columns: one pass, no cross join."""
    rules = {"small": "p_size < 10", "dear": "p_retailprice > 1500"}
    hits = F.filter(F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())
    return table(spark, d, "part").select("p_partkey", F.explode(hits).alias("rule"))


@query("e10b_task_repeats", "SELECT s_suppkey AS task, r AS repeat, (s_suppkey * 7 + r) % 3 = 0 AS accepted FROM supplier, (SELECT unnest([0, 1, 2]) AS r)")
def e10b(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("task"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat"))
    return rows.select("task", "repeat", ((F.col("task") * 7 + F.col("repeat")) % 3 == 0).alias("accepted"))


@query("e14_blast_radius_api", graph="SELECT e.src AS caller, count(*) AS calls FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'CALLS' AND e.dst = 'part:7' GROUP BY 1")
def e14(spark, d):
    from ..operators.neighbours import incoming

    return incoming(facts(spark, d), "CALLS", "part:7").groupBy(F.col("neighbour").alias("caller")).agg(F.count("*").alias("calls"))


@query("e15_explain_symbol", graph="SELECT kind, CASE WHEN dst = 'part:7' THEN 'in' ELSE 'out' END AS direction, count(*) AS n FROM edges WHERE src = 'part:7' OR dst = 'part:7' GROUP BY 1, 2")
def e15(spark, d):
    side = F.when(F.col("dst") == "part:7", "in").otherwise("out")
    return facts(spark, d).edges.where("src = 'part:7' OR dst = 'part:7'").groupBy("kind", side.alias("direction")).agg(F.count("*").alias("n"))


@query("e18_docs_for", graph="SELECT e.dst AS symbol, count(DISTINCT e.src) AS docs FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'MENTIONS' GROUP BY 1")
def e18(spark, d):
    from ..operators.neighbours import incoming

    return incoming(facts(spark, d), "MENTIONS").groupBy(F.col("node").alias("symbol")).agg(F.count_distinct("neighbour").alias("docs"))
