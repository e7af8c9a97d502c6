"""Queries of text, scalar functions and scans over documents, pages and parts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.fact_tables import facts
from .registry import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def pages(spark, d):
    return table(spark, d, "pages")


# --- scalar functions

IDENT = r"regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')"
IDENT_TOKENS = f"""list_distinct([CASE WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END
    FOR x IN string_split(lower({IDENT}), ' ') IF length(x) > 2 AND x NOT IN ({', '.join(repr(w) for w in X.STOP_WORDS)})])"""


@query("x01_identifier_tokens", lists=("tokens",), graph=f"SELECT id, list_sort({IDENT_TOKENS}) AS tokens FROM nodes WHERE kind IN ('Type', 'Function')")
def x01(spark, d):
    return facts(spark, d).nodes.where("kind IN ('Type', 'Function')").select("id", F.array_sort(X.identifier_tokens(F.col("name"))).alias("tokens"))


@query("x02_word_tokens", lists=("tokens",), sql=r"SELECT doc_id, list_sort(list_distinct([x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}]', ' ', 'g'), ' +') IF length(x) > 2])) AS tokens FROM documents")
def x02(spark, d):
    return docs(spark, d).select("doc_id", F.array_sort(X.word_tokens(F.col("text"))).alias("tokens"))


@query("x03_acronym_tokens", lists=("tokens",), graph=r"SELECT id, [lower(x) FOR x IN regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')] AS tokens FROM nodes WHERE kind = 'Type'")
def x03(spark, d):
    return facts(spark, d).nodes.where("kind = 'Type'").select("id", X.acronym_tokens(F.col("name")).alias("tokens"))


@query("x04_meaningful", lists=("tokens",), graph=f"""SELECT id, list_sort(CASE WHEN len(r) > 0 THEN r ELSE t END) AS tokens FROM (SELECT id, t, list_filter(t, lambda x: x NOT IN ({', '.join(repr(g) for g in X.GENERIC)})) AS r
    FROM (SELECT id, {IDENT_TOKENS} AS t FROM nodes WHERE kind = 'Type'))""")
def x04(spark, d):
    rows = facts(spark, d).nodes.where("kind = 'Type'").select("id", X.identifier_tokens(F.col("name")).alias("t"))
    return rows.select("id", F.array_sort(X.meaningful(F.col("t"))).alias("tokens"))


NORMAL = "CASE WHEN length(b) > 3 AND b LIKE '%s' THEN left(b, length(b) - 1) ELSE b END"


@query("x05_normal_names", f"SELECT p_partkey, {NORMAL} AS normal FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[_ ]', '', 'g') AS b FROM part)")
def x05(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normal_name(F.col("p_name")).alias("normal"))


@query("x06_near_statements", """SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name
    AND len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) * 3 >= len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' '))))""")
def x06(spark, d):
    """Pairs of different statements that share a third of their words.

    Of n words a statement is asked by its rarest n - ceil(n / 3) + 1: two alike share one of those,
    so what nearly all have in common pairs none of them.
    """
    words = table(spark, d, "part").select("p_name").distinct().select("p_name", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("k"))
    rare = words.join(often, "word").groupBy("p_name").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w"))
    n = F.size("w")
    keys = rare.select("p_name", F.explode(F.slice("w.word", F.lit(1), n - F.ceil(n / F.lit(3)).cast("int") + 1)).alias("word"))
    pairs = keys.select(F.col("p_name").alias("a"), "word").join(keys.select(F.col("p_name").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    wa, wb = F.split("a", " "), F.split("b", " ")
    return pairs.where(F.size(F.array_intersect(wa, wb)) * 3 >= F.size(F.array_union(wa, wb)))


@query("x08_area_of_name", graph="SELECT id, CASE WHEN contains(file, '/') THEN array_to_string(string_split(file, '/')[1:2], '/') ELSE file END AS area FROM nodes WHERE kind = 'Function' AND file IS NOT NULL")
def x08(spark, d):
    return facts(spark, d).nodes.where("kind = 'Function' AND file IS NOT NULL").select("id", F.substring_index("file", "/", 2).alias("area"))


@query("x09_zone_of", graph="SELECT DISTINCT string_split(string_split(file, '/')[1], '.')[1] AS zone FROM nodes WHERE file IS NOT NULL")
def x09(spark, d):
    return facts(spark, d).nodes.where("file IS NOT NULL").select(F.substring_index(F.substring_index("file", "/", 1), ".", 1).alias("zone")).distinct()


@query("x10_module_names", graph=r"SELECT DISTINCT replace(regexp_replace(regexp_replace(regexp_replace(file, '^src/', ''), '\.py$', ''), '/__init__$', ''), '/', '.') AS module FROM nodes WHERE file LIKE '%.py'")
def x10(spark, d):
    return facts(spark, d).nodes.where(F.col("file").endswith(".py")).select(X.module_name(F.col("file")).alias("module")).distinct()


@query("x11_relative_imports", graph="SELECT id, array_to_string(string_split(name, '.')[1:greatest(1, len(string_split(name, '.')) - 1)], '.') || '.shared' AS target FROM nodes WHERE kind = 'Module'")
def x11(spark, d):
    parts = F.split("name", r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), ".")
    return facts(spark, d).nodes.where("kind = 'Module'").select("id", F.concat(base, F.lit(".shared")).alias("target"))


PATH_SQL = "'/' || trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')"


@query("x12_url_paths", f"SELECT page_id, {PATH_SQL} AS path FROM pages")
def x12(spark, d):
    return pages(spark, d).select("page_id", X.url_path(F.col("url")).alias("path"))


@query("x13_join_urls", f"SELECT page_id, regexp_replace('/api/' || '/' || {PATH_SQL} || '/v1/', '/+', '/', 'g') AS path FROM pages")
def x13(spark, d):
    return pages(spark, d).select("page_id", F.regexp_replace(F.concat_ws("/", F.lit("/api/"), X.url_path(F.col("url")), F.lit("v1/")), "/+", "/").alias("path"))


@query("x14_heading_anchors", r"SELECT p_partkey, replace(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^\p{L}\p{N}_ -]', '', 'g'), ' ', '-') AS anchor FROM part")
def x14(spark, d):
    return table(spark, d, "part").select("p_partkey", X.heading_anchor(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("anchor"))


@query("x15_file_slugs", "SELECT page_id, coalesce(nullif(left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 80), ''), 'module') AS slug FROM pages")
def x15(spark, d):
    return pages(spark, d).select("page_id", X.file_slug(F.col("url")).alias("slug"))


KEY_SQL = "(c_mktsegment || '_v' || CAST(c_custkey % 7 AS STRING) || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '::R' || CAST(c_nationkey AS STRING) || '::I' || CAST(c_custkey % 3 AS STRING) END)"


def keyed(spark, d):
    key = F.concat("c_mktsegment", F.lit("_v"), (F.col("c_custkey") % 7).cast("string"), F.when(F.col("c_custkey") % 13 == 0, "").otherwise(F.concat(F.lit("::R"), F.col("c_nationkey").cast("string"), F.lit("::I"), (F.col("c_custkey") % 3).cast("string"))))
    return table(spark, d, "customer").select("c_custkey", key.alias("key"))


@query("x16_entity_keys", f"SELECT c_custkey, nullif(regexp_extract(k, '^(.+)_v([^:]+)::([^:]+)::([^:]+)$', 1), '') AS component, nullif(regexp_extract(k, '^(.+)_v([^:]+)::([^:]+)::([^:]+)$', 2), '') AS version, nullif(regexp_extract(k, '^(.+)_v([^:]+)::([^:]+)::([^:]+)$', 3), '') AS region, nullif(regexp_extract(k, '^(.+)_v([^:]+)::([^:]+)::([^:]+)$', 4), '') AS interface FROM (SELECT c_custkey, {KEY_SQL} AS k FROM customer)")
def x16(spark, d):
    return keyed(spark, d).select("c_custkey", *[v.alias(k) for k, v in X.entity_key(F.col("key")).items()])


@query("x17_format_entity_keys", f"SELECT c_custkey, {KEY_SQL} AS key FROM customer WHERE c_custkey % 13 <> 0")
def x17(spark, d):
    parts = keyed(spark, d).select("c_custkey", *[v.alias(k) for k, v in X.entity_key(F.col("key")).items()]).where("component IS NOT NULL")
    return parts.select("c_custkey", F.format_string("%s_v%s::%s::%s", "component", "version", "region", "interface").alias("key"))


@query("x18_percent_encode", "SELECT p_partkey, 'urn:x:' || replace(url_encode(p_name), '%20', '+') AS iri FROM part")
def x18(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("urn:x:"), F.url_encode("p_name")).alias("iri"))


@query("x19_durations", "SELECT event_id, CASE WHEN m // 60 = 0 THEN CAST(m % 60 AS STRING) || 'm' WHEN m % 60 = 0 THEN CAST(m // 60 AS STRING) || 'h' ELSE CAST(m // 60 AS STRING) || 'h ' || CAST(m % 60 AS STRING) || 'm' END AS duration FROM (SELECT event_id, CAST(greatest(1, ceil(value * 100 / 60)) AS BIGINT) AS m FROM events)")
def x19(spark, d):
    return table(spark, d, "events").select("event_id", X.duration(F.col("value") * 100).alias("duration"))


@query("x20_tolerance", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN abs(l_discount) <= 0.1 ELSE abs(l_discount - l_tax) <= 0.1 * abs(l_tax) END AS ok FROM lineitem")
def x20(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.within_tolerance(F.col("l_discount"), F.col("l_tax"), 0.1).alias("ok"))


@query("x21_cursor", "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS cursor FROM events")
def x21(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", text.try_cast("timestamp_ntz").alias("cursor"))


@query("x22_safe_cast", "SELECT o_orderkey, try_cast(left(o_orderpriority, 1) AS DOUBLE) AS level, try_cast(o_orderstatus AS DOUBLE) AS bad FROM orders")
def x22(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).try_cast("double").alias("level"), F.col("o_orderstatus").try_cast("double").alias("bad"))


@query("x23_drift_findings", """SELECT user_id, k AS metric, CASE WHEN v > 90 THEN 'critical' WHEN v > 60 THEN 'warning' ELSE 'info' END AS severity, v AS observed
    FROM (SELECT user_id, 'k' AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events)""")
def x23(spark, d):
    rows = table(spark, d, "events").select("user_id", F.explode(F.from_json("props", "map<string, long>")).alias("metric", "observed"))
    v = F.col("observed")
    return rows.select("user_id", "metric", F.when(v > 90, "critical").when(v > 60, "warning").otherwise("info").alias("severity"), "observed")


@query("x26_encode_arguments", """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || CAST(user_id AS STRING) || '}' AS args FROM events""")
def x26(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("args"))


@query("x27_json_types", "SELECT event_id, coalesce(CASE json_type(json_extract(props, '$.k')) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' END, 'any') AS label FROM events")
def x27(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", F.when(F.rlike(k, F.lit(r"^-?\d+$")), "integer").otherwise("any").alias("label"))


@query("x28_digest", graph="SELECT kind, sha256(string_agg(id || ':' || name, ';' ORDER BY id)) AS digest FROM nodes WHERE kind IN ('Module', 'Endpoint', 'Intent', 'Type') GROUP BY kind")
def x28(spark, d):
    """One digest of each kind's rows, sorted: hashing is sequential by definition, so a kind is one group."""
    rows = facts(spark, d).nodes.where("kind IN ('Module', 'Endpoint', 'Intent', 'Type')").select("kind", F.struct("id", "name").alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat_ws(":", r["id"], r["name"])), ";")
    return rows.groupBy("kind").agg(F.sha2(joined, 256).alias("digest"))


@query("x29_fingerprint", "SELECT left(sha256(string_agg(n_name || '=' || CAST(n_regionkey AS STRING), ',' ORDER BY n_name)), 16) AS fingerprint FROM nation")
def x29(spark, d):
    rows = table(spark, d, "nation").select(F.struct("n_name", "n_regionkey").alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat_ws("=", r["n_name"], r["n_regionkey"].cast("string"))), ",")
    return rows.agg(F.left(F.sha2(joined, 256), F.lit(16)).alias("fingerprint"))


@query("x30_basenames", graph="SELECT DISTINCT list_extract(string_split(file, '/'), -1) AS base FROM nodes WHERE file IS NOT NULL")
def x30(spark, d):
    return facts(spark, d).nodes.where("file IS NOT NULL").select(F.substring_index("file", "/", -1).alias("base")).distinct()


@query("x31_exception_classes", "SELECT event_id, list_extract(string_split(string_split('app.core.' || event_type || 'Error: bad ' || CAST(user_id AS STRING), ':')[1], '.'), -1) AS cls FROM events")
def x31(spark, d):
    text = F.concat(F.lit("app.core."), "event_type", F.lit("Error: bad "), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.substring_index(F.substring_index(text, ":", 1), ".", -1).alias("cls"))


@query("x32b_articles", lists=("terms",), sql=r"SELECT doc_id, regexp_extract_all(text, '(?:the|la|der) ([a-z]{6,})', 1) AS terms FROM documents")
def x32b(spark, d):
    found = F.regexp_extract_all("text", F.lit("(?:the|la|der) ([a-z]{6,})"), F.lit(1))
    return docs(spark, d).select("doc_id", found.alias("terms"))


@query("x33_dot_ids", graph="""SELECT id, '"' || replace(name, '"', '\\"') || '"' AS dot FROM nodes WHERE kind = 'Module'""")
def x33(spark, d):
    return facts(spark, d).nodes.where("kind = 'Module'").select("id", F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('\\"')), F.lit('"')).alias("dot"))


@query("x34_cache_keys", "SELECT page_id, left(sha1(url), 16) AS key FROM pages")
def x34(spark, d):
    return pages(spark, d).select("page_id", F.left(F.sha1("url"), F.lit(16)).alias("key"))


@query("x35_label_lines", lists=("labels",), sql=r"SELECT doc_id, list_distinct([trim(regexp_replace(x, '\s+', ' ', 'g')) FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[\p{L}\p{N}]') AND length(trim(regexp_replace(x, '\s+', ' ', 'g'))) >= 3]) AS l FROM documents".replace("SELECT doc_id, list_distinct", "SELECT doc_id, list_sort(list_distinct").replace(">= 3]) AS l", ">= 3])) AS labels"))
def x35(spark, d):
    lines_ = F.transform(F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[\p{L}\p{N}]"))), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return docs(spark, d).select("doc_id", F.array_sort(F.array_distinct(F.filter(lines_, lambda x: F.length(x) >= 3))).alias("labels"))


@query("x36_luhn", r"""SELECT doc_id, digits, list_sum([CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INT ELSE (digits[i]::INT * 2) // 10 + (digits[i]::INT * 2) % 10 END FOR i IN range(1, length(digits) + 1)]) % 10 = 0 AS ok
    FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b\d{13,16}\b'))) AS digits FROM documents)""")
def x36(spark, d):
    digits = docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b\d{13,16}\b"), F.lit(0)))).alias("digits"))
    return digits.select("doc_id", "digits", F.expr("luhn_check(digits)").alias("ok"))


@query("x37_json_fields", "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def x37(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string, string>")).alias("path", "value"))


@query("x38_collapse", r"SELECT doc_id, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[.,;:!?]+$', '') AS text FROM documents")
def x38(spark, d):
    return docs(spark, d).select("doc_id", X.collapse(F.col("text")).alias("text"))


@query("x40_task_types", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'migrat') THEN 'migration' WHEN regexp_matches(lower(text), 'fix|bug') THEN 'bugfix' ELSE 'feature' END AS kind FROM documents")
def x40(spark, d):
    low = F.lower("text")
    return docs(spark, d).select("doc_id", F.when(F.rlike(low, F.lit("migrat")), "migration").when(F.rlike(low, F.lit("fix|bug")), "bugfix").otherwise("feature").alias("kind"))


# --- documents as lines, sections, patches


def lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents"


@query("s24_sections", f"SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^[A-Z][a-z]+\\.$')) AS headings FROM ({LINES}) GROUP BY 1")
def s24(spark, d):
    heading = F.rlike("line", F.lit(r"^[A-Z][a-z]+\.$"))
    return lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(heading).alias("headings"))


@query("s24b_section_bounds", f"SELECT doc_id, pos AS first, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next_first, line AS title FROM ({LINES}) WHERE regexp_matches(line, '^[A-Z][a-z]+\\.$')")
def s24b(spark, d):
    """Where each section begins and the next one does; a document's lines stay in one array, so nothing is shuffled."""
    split = docs(spark, d).select("doc_id", F.split("text", "\n").alias("l"))
    heads = split.select("doc_id", F.filter(F.transform("l", lambda x, i: F.struct(i.cast("long").alias("first"), x.alias("title"))), lambda h: F.rlike(h["title"], F.lit(r"^[A-Z][a-z]+\.$"))).alias("h"))
    bound = F.transform("h", lambda x, i: F.struct(x["first"].alias("first"), F.get(F.col("h"), i + 1)["first"].alias("next_first"), x["title"].alias("title")))
    return heads.select("doc_id", F.explode(bound).alias("s")).select("doc_id", "s.first", "s.next_first", "s.title")


TEXT_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*(</p>[^<]*)?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("s25c_tags_stripped", f"SELECT page_id, {TEXT_SQL} AS body FROM pages")
def s25c(spark, d):
    bare = F.regexp_replace(F.regexp_replace("html", r"<(script|style)[^>]*>[^<]*(</p>[^<]*)?</(script|style)>", " "), "<[^>]*>", " ")
    return pages(spark, d).select("page_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("body"))


@query("s25b_html_headings", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, len(regexp_extract_all(html, '<a href='))::INT AS links FROM pages")
def s25b(spark, d):
    return pages(spark, d).select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).alias("links"))


@query("s52_document_lookup", "SELECT doc_id, CASE WHEN strlen(text) > 4194304 THEN NULL ELSE text END AS text, n_chars FROM documents WHERE doc_id IN (3, 14, 15)")
def s52(spark, d):
    return docs(spark, d).where(F.col("doc_id").isin(3, 14, 15)).select("doc_id", F.when(F.octet_length("text") <= 4 << 20, F.col("text")).alias("text"), "n_chars")  # larger ones by their metadata only


@query("s53_artifact", "SELECT page_id, base64(encode(url)) AS content FROM pages")
def s53(spark, d):
    return pages(spark, d).select("page_id", F.replace(F.base64(F.col("url").cast("binary")), F.lit("\r\n"), F.lit("")).alias("content"))  # one line: Spark may cut it after every 76 characters


PATCH_SQL = "'@@ -' || CAST(l_orderkey % 90 + 1 AS STRING) || ',3 +' || CAST(l_orderkey % 70 + 1 AS STRING) || ',4 @@' || chr(10) || ' context' || chr(10) || '+added ' || CAST(l_partkey AS STRING) || chr(10) || '-removed' || chr(10) || '+last ' || CAST(l_suppkey AS STRING)"


def patches(li, patch_id="l_orderkey"):
    c = lambda x: F.col(x).cast("string")
    head = F.concat(F.lit("@@ -"), (F.col("l_orderkey") % 90 + 1).cast("string"), F.lit(",3 +"), (F.col("l_orderkey") % 70 + 1).cast("string"), F.lit(",4 @@\n context\n+added "), c("l_partkey"), F.lit("\n-removed\n+last "), c("l_suppkey"))
    return li.select(F.expr(patch_id).alias("patch_id"), head.alias("patch"))


def added_lines(p):
    """(patch_id, line_no, content) of added lines; a hunk header resets the count, removed lines don't advance it.

    A patch is read once, line by line, where it stands: linear in its lines, and nothing is shuffled.
    """
    header = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)")

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for patch_id, patch in zip(f["patch_id"], f["patch"]):
                at = 0
                for line in (patch or "").split("\n"):
                    if found := header.match(line):
                        at = int(found[1])
                        continue
                    if line.startswith("+"):
                        out.append((patch_id, at, line[1:]))
                    at += not line.startswith("-")
            yield pd.DataFrame(out, columns=["patch_id", "line_no", "content"])

    return p.select("patch_id", "patch").mapInPandas(run, f"patch_id {p.schema['patch_id'].dataType.simpleString()}, line_no long, content string")


@query("s57_added_lines", "SELECT l_orderkey * 8 + l_linenumber AS patch_id, l_orderkey % 70 + 2 AS line_no, 'added ' || CAST(l_partkey AS STRING) AS content FROM lineitem UNION ALL SELECT l_orderkey * 8 + l_linenumber, l_orderkey % 70 + 3, 'last ' || CAST(l_suppkey AS STRING) FROM lineitem")
def s57(spark, d):
    return added_lines(patches(table(spark, d, "lineitem"), "l_orderkey * 8 + l_linenumber"))


@query("s56_stack_frames", """SELECT event_id, 'src/p' || CAST(user_id % 40 AS STRING) || '.py' AS file, user_id % 90 + 1 AS line, 'f' || CAST(user_id AS STRING) AS func FROM events""")
def s56(spark, d):
    u = F.col("user_id")
    trace = F.concat(F.lit('Traceback\n  File "src/p'), (u % 40).cast("string"), F.lit('.py", line '), (u % 90 + 1).cast("string"), F.lit(", in f"), u.cast("string"), F.lit("\nValueError: bad"))
    rows = table(spark, d, "events").select("event_id", F.explode(F.split(trace, "\n")).alias("l"))
    form = r'File "([^"]+)", line (\d+), in (\w+)'
    hit = rows.where(F.rlike("l", F.lit(form)))
    return hit.select("event_id", F.regexp_extract("l", form, 1).alias("file"), F.regexp_extract("l", form, 2).cast("long").alias("line"), F.regexp_extract("l", form, 3).alias("func"))


# --- scans


def rule_hits(rows, key, text, rules):
    """(key, rule) of every rule that matches: one pass, the rules being columns."""
    hits = F.filter(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(n)) for n, p in rules]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(hits).alias("rule"))


C15_SQL = " UNION ALL ".join(f"SELECT doc_id, pos AS line_no, '{n}' AS rule FROM ({LINES}) WHERE regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches(line, '{X.PLACEHOLDER}')" for n, p in X.SECRET_RULES)


@query("c15_secrets", C15_SQL)
def c15(spark, d):
    rows = lines(spark, d).withColumn("line_no", F.col("pos").cast("long")).where(~F.rlike("line", F.lit(X.PLACEHOLDER)))
    return rule_hits(rows, ["doc_id", "line_no"], F.col("line"), X.SECRET_RULES)


SECURITY = [("eval_call", r"\beval\b"), ("exec_call", r"\bexec\b"), ("shell", r"shell"), ("pickle", r"pickle\.loads?"), ("md5", r"\bmd5\b"), ("http_url", r"http://[^/]+\.example\.")]


@query("c16_security", " UNION ALL ".join(f"SELECT page_id, '{n}' AS rule FROM pages WHERE regexp_matches(url || ' ' || html, '{p}')" for n, p in SECURITY))
def c16(spark, d):
    return rule_hits(pages(spark, d).withColumn("t", F.concat_ws(" ", "url", "html")), ["page_id"], F.col("t"), SECURITY)


STYLE = [("todo", r"TODO|FIXME|XXX"), ("trailing_space", r"[ \t]+$"), ("shouting", r"[A-Z]{6,}!!")]


@query("c17_style", f"SELECT doc_id, pos AS line_no, 'long_line' AS rule FROM ({LINES}) WHERE length(line) > 120 UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, pos, '{n}' FROM ({LINES}) WHERE regexp_matches(line, '{p}')" for n, p in STYLE))
def c17(spark, d):
    rows = lines(spark, d).withColumn("line_no", F.col("pos").cast("long"))
    hits = F.array(F.when(F.length("line") > 120, F.lit("long_line")), *[F.when(F.rlike("line", F.lit(p)), F.lit(n)) for n, p in STYLE])
    return rows.select("doc_id", "line_no", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule"))


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"), ("us_phone", r"\(\d{3}\) \d{3}-\d{4}"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"), ("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")]


@query("c20_pii", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, len(regexp_extract_all(text, '{p}')) AS hits FROM documents WHERE regexp_matches(text, '{p}')" for n, p in PII))
def c20(spark, d):
    counts = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count("text", F.lit(p)).cast("long").alias("hits")) for n, p in PII])
    return docs(spark, d).select("doc_id", F.explode(F.filter(counts, lambda x: x["hits"] > 0)).alias("x")).select("doc_id", "x.rule", "x.hits")


@query("c20b_conversation_pii", " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS rule FROM conversations WHERE regexp_matches(text, '{p}')" for n, p in PII))
def c20b(spark, d):
    return rule_hits(table(spark, d, "conversations"), ["conv_id", "turn"], F.col("text"), PII)


@query("f14_symbolish", graph=r"SELECT DISTINCT name, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_.]*$') AND list_extract(string_split(name, '.'), -1) NOT IN ('py', 'md', 'sql', 'asia') AS symbolish FROM nodes WHERE kind IN ('Module', 'Type')")
def f14(spark, d):
    rows = facts(spark, d).nodes.where("kind IN ('Module', 'Type')").select("name").distinct()
    return rows.select("name", (F.rlike("name", F.lit("^[A-Za-z_][A-Za-z0-9_.]*$")) & ~F.substring_index("name", ".", -1).isin("py", "md", "sql", "asia")).alias("symbolish"))


F29_CASES = [("eq", "l_quantity", 10.0), ("ne", "l_quantity", 10.0), ("gt", "l_discount", 0.05), ("ge", "l_discount", 0.05), ("lt", "l_tax", 0.02), ("le", "l_tax", 0.02), ("in_range", "l_quantity", (5.0, 9.0)), ("in", "l_linenumber", (1, 3)), ("len_gt", "l_linestatus", 1), ("len_ge", "l_linestatus", 1), ("not_empty", "l_returnflag", None)]
_SQL_OPS = {"eq": "{0} = {1}", "ne": "{0} <> {1}", "gt": "{0} > {1}", "ge": "{0} >= {1}", "lt": "{0} < {1}", "le": "{0} <= {1}", "len_gt": "length({0}) > {1}", "len_ge": "length({0}) >= {1}"}


def _case_sql(op, col, v):
    test = f"{col} BETWEEN {v[0]} AND {v[1]}" if op == "in_range" else f"{col} IN {v}" if op == "in" else f"length({col}) > 0" if op == "not_empty" else _SQL_OPS[op].format(col, v)
    return f"SELECT '{op}' AS op, count(*) FILTER (coalesce({test}, false)) AS passed FROM lineitem"


@query("f29_predicates", " UNION ALL ".join(_case_sql(*c) for c in F29_CASES))
def f29(spark, d):
    rows = table(spark, d, "lineitem").agg(*[F.count_if(X.predicate(op, F.col(c), v)).alias(op) for op, c, v in F29_CASES])
    return rows.selectExpr(f"stack({len(F29_CASES)}, " + ", ".join(f"'{op}', `{op}`" for op, _, _ in F29_CASES) + ") AS (op, passed)")


@query("f30_read_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS missing FROM events")
def f30(spark, d):
    v = F.parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.a.b", "long").alias("missing"))


BANDS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 9 > 1 OR l_discount * 9 < 0.5 * 0.9 THEN 'fail' WHEN l_discount * 9 < 0.5 THEN 'warn' ELSE 'pass' END AS verdict FROM lineitem"


def bands(li):
    return li.select("l_orderkey", "l_linenumber", X.confidence_band(F.col("l_discount") * 9, 0.5).alias("verdict"))


@query("f31_confidence_bands", BANDS)
def f31(spark, d):
    return bands(table(spark, d, "lineitem"))


@query("f32_policy_rules", "SELECT page_id, CASE WHEN p = '/' THEN 'deny' WHEN p LIKE '/fr/%' THEN 'ask' WHEN p LIKE '/%/1%' THEN 'allow' ELSE 'deny' END AS decision FROM (SELECT page_id, " + PATH_SQL + " AS p FROM pages)")
def f32(spark, d):
    """First rule that matches, exact names before globs, then the default."""
    p = X.url_path(F.col("url"))
    return pages(spark, d).select("page_id", F.when(p == "/", "deny").when(p.like("/fr/%"), "ask").when(p.like("/%/1%"), "allow").otherwise("deny").alias("decision"))
