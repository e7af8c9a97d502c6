"""Queries of the linking joins: imports, entities, documents, intents, routes, traces, mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import links as L
from ..operators import neighbours as N
from ..operators.traversal import write_once
from ..sources.fact_tables import NODES_SQL, facts
from . import graph_queries as G
from .registry import query
from .text_queries import IDENT_TOKENS, NORMAL


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- imports: dotted paths made of a nation's module name and a tail


PATHS = "SELECT DISTINCT n.name || '.' || lower(replace(p_type, ' ', '_')) || '.x' || CAST(p_size % 3 AS STRING) AS path FROM nodes n JOIN part ON p_partkey % 25 = CAST(split_part(n.id, ':', 2) AS INT) WHERE n.id LIKE 'nation:%' UNION SELECT DISTINCT 'ext.' || split_part(p_name, ' ', 1) FROM part"


def paths(spark, d):
    n = facts(spark, d).nodes.where("id LIKE 'nation:%'").select("name", F.substring_index("id", ":", -1).cast("long").alias("k"))
    p = table(spark, d, "part").select((F.col("p_partkey") % 25).alias("k"), F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit(".x"), (F.col("p_size") % 3).cast("string")).alias("tail"), "p_name")
    inside = p.select("k", "tail").distinct().join(n, "k").select(F.concat_ws(".", "name", "tail").alias("path"))
    return inside.unionByName(p.select(F.concat(F.lit("ext."), F.substring_index("p_name", " ", 1)).alias("path"))).distinct()


LONGEST = f""", paths AS ({PATHS}), parts AS (SELECT path, unnest(range(1, len(string_split(path, '.')) + 1)) AS n FROM paths),
    hits AS (SELECT path, array_to_string(string_split(path, '.')[1:n], '.') AS prefix, n FROM parts)
    SELECT path, arg_max(prefix, n) AS match FROM hits WHERE prefix IN (SELECT name FROM nodes WHERE kind = 'Module' AND NOT external) GROUP BY path"""


@query("j21_longest_prefix", graph=LONGEST)
def j21(spark, d):
    mods = facts(spark, d).nodes.where("kind = 'Module' AND NOT external")
    return L.longest_prefix_join(paths(spark, d), "path", mods, "name")


@query("j20_link_imports", graph=LONGEST.replace("SELECT path, arg_max(prefix, n) AS match", ", best AS (SELECT path, arg_max(prefix, n) AS match") + ") SELECT p.path, coalesce(b.match, p.path) AS target, b.match IS NULL AS external FROM paths p LEFT JOIN best b ON b.path = p.path")
def j20(spark, d):
    """Repoint imports at the first-party module they resolve to; the others stay external."""
    p = paths(spark, d)
    mods = facts(spark, d).nodes.where("kind = 'Module' AND NOT external")
    best = L.longest_prefix_join(p, "path", mods, "name")
    return p.join(best, "path", "left").select("path", F.coalesce("match", "path").alias("target"), F.col("match").isNull().alias("external"))


@query("j22_relative_paths", graph="SELECT f, coalesce(a.file, b.file) AS target FROM (SELECT DISTINCT regexp_replace(file, '\\.py$', '') AS f FROM nodes WHERE kind = 'Module' AND file IS NOT NULL UNION SELECT DISTINCT regexp_replace(file, '/__init__\\.py$', '') FROM nodes WHERE kind = 'Module' AND file IS NOT NULL) x LEFT JOIN (SELECT DISTINCT file FROM nodes) a ON a.file = x.f || '.py' LEFT JOIN (SELECT DISTINCT file FROM nodes) b ON b.file = x.f || '/__init__.py'")
def j22(spark, d):
    nodes = facts(spark, d).nodes
    mods = nodes.where("kind = 'Module' AND file IS NOT NULL")
    f = mods.select(F.explode(F.array(F.regexp_replace("file", r"\.py$", ""), F.regexp_replace("file", r"/__init__\.py$", ""))).alias("f")).distinct()
    files = nodes.select("file").distinct()
    plain, index = files.select(F.col("file").alias("a")), files.select(F.col("file").alias("b"))
    return f.join(plain, F.concat("f", F.lit(".py")) == F.col("a"), "left").join(index, F.concat("f", F.lit("/__init__.py")) == F.col("b"), "left").select("f", F.coalesce("a", "b").alias("target"))


@query("j23_strip_prefix", graph="SELECT DISTINCT x.file, m.id FROM (SELECT DISTINCT file FROM nodes WHERE file LIKE 'src/%') x JOIN nodes m ON m.kind = 'Module' AND m.file = x.file AND replace(regexp_replace(x.file, '^src/', ''), '.py', '') <> ''")
def j23(spark, d):
    nodes = facts(spark, d).nodes
    files = nodes.where("file LIKE 'src/%'").select("file").distinct().where(F.replace(F.regexp_replace("file", "^src/", ""), F.lit(".py"), F.lit("")) != "")
    return files.join(nodes.where("kind = 'Module'").select("file", "id"), "file").select("file", "id")


@query(
    "j24_unique_suffix",
    graph=""", raws AS (SELECT DISTINCT list_extract(string_split(file, '/'), -1) AS raw FROM nodes WHERE file IS NOT NULL UNION SELECT DISTINCT array_to_string(string_split(file, '/')[-2:], '/') FROM nodes WHERE file IS NOT NULL),
        files AS (SELECT DISTINCT file FROM nodes WHERE file IS NOT NULL)
        SELECT raw, min(file) AS match FROM raws JOIN files ON file = raw OR file LIKE '%/' || replace(replace(raw, '_', '\\_'), '%', '\\%') ESCAPE '\\' GROUP BY raw HAVING count(*) = 1""",
)
def j24(spark, d):
    files = facts(spark, d).nodes.where("file IS NOT NULL").select("file").distinct()
    raws = files.select(F.explode(F.array(F.substring_index("file", "/", -1), F.substring_index("file", "/", -2))).alias("raw")).distinct()
    return L.unique_suffix_join(raws, "raw", files, "file")


# --- entities, containment, calls


CUST_NORMAL = f"SELECT id, external, {NORMAL} AS k FROM (SELECT id, external, regexp_replace(lower(name), '[_ ]', '', 'g') AS b FROM nodes WHERE kind = 'Type' AND id LIKE 'customer:%')"


ENTITIES = f", n AS ({CUST_NORMAL}) SELECT a.id AS orm, b.id AS db FROM (SELECT min(id) AS id, k FROM n WHERE NOT external GROUP BY k HAVING count(*) = 1) a JOIN (SELECT min(id) AS id, k FROM n WHERE external GROUP BY k HAVING count(*) = 1) b ON b.k = a.k"


@query("j25_entity_resolution", graph=ENTITIES)
def j25(spark, d):
    """Types of the source against external ones: each customer type is on one side."""
    named = facts(spark, d).nodes.where("kind = 'Type' AND id LIKE 'customer:%'").select("id", "external", X.normal_name(F.col("name")).alias("k"))
    unique = lambda part, as_: named.where(part).groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias(as_)).where("n = 1").select("k", as_)
    return unique("NOT external", "orm").join(unique("external", "db"), "k").select("orm", "db")


@query("j34_set_containment", """WITH s AS (SELECT DISTINCT l_orderkey AS small, l_partkey AS e FROM lineitem), g AS (SELECT DISTINCT l_suppkey AS large, l_partkey AS e FROM lineitem)
    SELECT small, large FROM s JOIN g USING (e) JOIN (SELECT small, count(*) AS need FROM s GROUP BY small) USING (small) GROUP BY small, large HAVING count(*) = any_value(need)""")
def j34(spark, d):
    """Orders all of whose parts a supplier has delivered: whole sets on both sides."""
    li = table(spark, d, "lineitem")
    return L.containment_join(li, li, "l_orderkey", "l_suppkey", "l_partkey")


@query("j35_repoint_undeclared", graph="SELECT e.src, CASE WHEN n.id IS NULL THEN 'ext:' || e.dst ELSE e.dst END AS dst, n.id IS NULL AS external FROM (SELECT src, CASE WHEN line % 17 = 0 THEN 'gone:' || CAST(line AS STRING) ELSE dst END AS dst FROM edges WHERE kind = 'IMPLEMENTS') e LEFT JOIN nodes n ON n.id = e.dst")
def j35(spark, d):
    g = facts(spark, d)
    e = N.edges_of_kind(g, "IMPLEMENTS").select("src", F.when(F.col("line") % 17 == 0, F.concat(F.lit("gone:"), F.col("line").cast("string"))).otherwise(F.col("dst")).alias("d"))
    known = e.join(g.nodes.select("id"), F.col("d") == F.col("id"), "left")
    return known.select("src", F.when(F.col("id").isNull(), F.concat(F.lit("ext:"), "d")).otherwise(F.col("d")).alias("dst"), F.col("id").isNull().alias("external"))


@query("j36_invented_calls", graph="SELECT e.src, e.dst, e.line FROM edges e JOIN nodes t ON t.id = e.dst AND t.external JOIN nodes s ON s.id = e.src AND s.kind = 'Function' WHERE e.kind = 'CALLS' AND e.line % 100 BETWEEN s.line % 50 AND s.line % 50 + 30")
def j36(spark, d):
    g = facts(spark, d)
    calls = N.edges_of_kind(g, "CALLS").select("src", "dst", F.col("line").alias("at_line"))
    ext = g.nodes.where("external").select(F.col("id").alias("dst"))
    scope = g.nodes.where("kind = 'Function'").select(F.col("id").alias("src"), (F.col("line") % 50).alias("first"))
    rows = calls.join(ext, "dst", "left_semi").join(scope, "src")
    return rows.where((F.col("at_line") % 100).between(F.col("first"), F.col("first") + 30)).select("src", "dst", F.col("at_line").alias("line"))


@query("c06_invention_summary", graph="SELECT count(*) AS checked, count(*) FILTER (t.external) AS suspicious FROM edges e JOIN nodes t ON t.id = e.dst WHERE e.kind = 'CALLS'")
def c06(spark, d):
    g = facts(spark, d)
    return N.edges_of_kind(g, "CALLS").join(g.nodes.select(F.col("id").alias("dst"), "external"), "dst").agg(F.count("*").alias("checked"), F.count_if("external").alias("suspicious"))


# --- documents: mentions are what a text names as code


#: A page about each part. Every third page names the part outside backticks only.
PAGES = """SELECT p_partkey AS page, 'Call ' || CASE WHEN p_partkey % 3 = 0 THEN s || '()' ELSE '`' || s || '()` or ' || s END
    || ' of `' || CASE p_partkey % 4 WHEN 0 THEN area || '.' || leaf WHEN 1 THEN 'old.' || leaf WHEN 2 THEN leaf ELSE 'gone.x' END
    || '`, see shop.' || area || '.' || leaf || ' and ' || camel || '; in `src/' || area || '/' || leaf || '.py`, not `two words`; e_g www.shop.example.com; `' || CASE p_partkey % 6 WHEN 0 THEN 'parts/p' || CAST(p_partkey % 60 AS STRING) || '.py' WHEN 1 THEN 'p' || CAST(p_partkey % 60 AS STRING) || '.py'
    WHEN 2 THEN '/etc/' || leaf || '.toml' WHEN 3 THEN 'old/' || s || '.yaml' WHEN 4 THEN 'LIMIT_' || upper(leaf) ELSE 'main' END || '`' AS text
    FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS s, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], '') AS camel,
          lower(r_name) AS area, lower(n_name) AS leaf FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey)"""


def part_pages(spark, d):
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "part").join(F.broadcast(places), F.col("n_nationkey") == F.col("p_partkey") % 25)  # 25 nations
    k, s, area, leaf = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lower("r_name"), F.lower("n_name")
    camel = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")
    named = F.when(k % 3 == 0, F.concat(s, F.lit("()"))).otherwise(F.concat(F.lit("`"), s, F.lit("()` or "), s))
    owner = F.when(k % 4 == 0, F.concat_ws(".", area, leaf)).when(k % 4 == 1, F.concat_ws(".", F.lit("old"), leaf)).when(k % 4 == 2, leaf).otherwise(F.lit("gone.x"))
    number, cases = (k % 60).cast("string"), k % 6
    also = F.when(cases == 0, F.concat(F.lit("parts/p"), number, F.lit(".py"))).when(cases == 1, F.concat(F.lit("p"), number, F.lit(".py"))).when(cases == 2, F.concat(F.lit("/etc/"), leaf, F.lit(".toml")))
    also = also.when(cases == 3, F.concat(F.lit("old/"), s, F.lit(".yaml"))).when(cases == 4, F.concat(F.lit("LIMIT_"), F.upper(leaf))).otherwise(F.lit("main"))
    words = ["Call ", named, " of `", owner, "`, see shop.", area, ".", leaf, " and ", camel, "; in `src/", area, "/", leaf, ".py`, not `two words`; e_g www.shop.example.com; `", also, "`"]
    return rows.select(k.alias("page"), F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words]).alias("text"))


X07 = rf"""SELECT page, m AS mention, arg_min(kind, rank) AS kind FROM (
    SELECT page, m, 1 AS rank, CASE WHEN contains(m, '/') OR regexp_matches(m, '{X.MENTIONED_FILE}') THEN 'file' WHEN regexp_full_match(m, '{X.MENTIONED_NAME}') THEN 'backtick' END AS kind
        FROM (SELECT page, trim(trim(unnest(regexp_extract_all(text, '{X.BACKTICKED}', 1))), '()') AS m FROM ({PAGES}))
    UNION ALL SELECT page, m, 2, 'dotted' FROM (SELECT page, unnest(regexp_extract_all(regexp_replace(text, '{X.BACKTICKED}', ' ', 'g'), '{X.DOTTED}')) AS m FROM ({PAGES}))
        WHERE list_extract(string_split(lower(m), '.'), -1) NOT IN ({", ".join(repr(t) for t in X.URL_TAILS)})
    UNION ALL SELECT page, m, 3, 'snake' FROM (SELECT page, unnest(regexp_extract_all(regexp_replace(text, '{X.BACKTICKED}', ' ', 'g'), '{X.SNAKE}')) AS m FROM ({PAGES})) WHERE m NOT IN ('e_g', 'i_e')
    UNION ALL SELECT page, unnest(regexp_extract_all(regexp_replace(text, '{X.BACKTICKED}', ' ', 'g'), '{X.CAMEL}')), 4, 'camel' FROM ({PAGES})
    ) WHERE kind IS NOT NULL AND m <> '' GROUP BY page, m"""


@query("x07_mentions", X07)
def x07(spark, d):
    """What each page names as code, and in which form; a mention in several forms has the first one."""
    return X.mentions(part_pages(spark, d), "page", "text")


SYMBOLS = """SELECT 'shop.' || lower(r_name) || '.' || lower(n_name) AS tail, lower(n_name) AS name, 'src/' || lower(r_name) || '/' || lower(n_name) || '.py' AS file FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'shop.parts.' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING), replace(p_name, ' ', '_'), 'src/parts/p' || CAST(p_partkey % 40 AS STRING) || '.py' FROM part"""
FILES = f"SELECT DISTINCT file FROM ({NODES_SQL}) WHERE file IS NOT NULL"
HITS = f"""asked AS (SELECT DISTINCT mention AS m, kind = 'file' AS is_file FROM said), sym AS ({SYMBOLS}), hits AS (
    SELECT m, is_file, 0 AS step, file AS tail, file FROM asked JOIN ({FILES}) ON contains(file, m) WHERE is_file
    UNION ALL SELECT m, is_file, 1, tail, file FROM asked JOIN sym ON lower(tail) = lower(m) WHERE NOT is_file
    UNION ALL SELECT m, is_file, 2, tail, file FROM asked JOIN sym ON lower(name) = lower(m) WHERE NOT is_file
    UNION ALL SELECT m, is_file, 3, tail, file FROM asked JOIN sym ON contains(m, '.') AND ends_with(lower(tail), '.' || lower(m)) WHERE NOT is_file
    UNION ALL SELECT m, is_file, 4, tail, file FROM asked JOIN sym ON contains(m, '.') AND lower(name) = list_extract(string_split(lower(m), '.'), -1) WHERE NOT is_file),
    anchor AS (SELECT * FROM hits h WHERE step = (SELECT min(step) FROM hits g WHERE g.m = h.m AND g.is_file = h.is_file)),
    bound AS (SELECT m, is_file, step, count(DISTINCT tail) AS anchors, min(tail) AS match FROM anchor GROUP BY 1, 2, 3)"""
BOUND = f"WITH said AS ({X07}), {HITS}"
DRIFTS = r"""NOT (kind = 'camel' OR regexp_matches(mention, '^[A-Z][A-Z0-9_]+$')) AND NOT (kind = 'file' AND regexp_matches(mention, '^(/|~|\.\.)|[* ]'))
    AND NOT (kind = 'backtick' AND regexp_matches(mention, '^[a-z][a-z0-9]*$'))"""
REVIEWED = f"""{BOUND}, reviewed AS (SELECT page, mention, kind, coalesce(step, -1) AS step, coalesce(anchors, 0) AS anchors, match, step IS NULL AND {DRIFTS} AS drifts, {DRIFTS} AS claims
    FROM said LEFT JOIN bound ON m = mention AND is_file = (kind = 'file'))"""


def symbols(spark, d):
    """Symbols by their dotted path and last name, with the file that defines them."""
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    file = F.concat(F.lit("src/parts/p"), (F.col("p_partkey") % 40).cast("string"), F.lit(".py"))
    parts = table(spark, d, "part").select(F.concat(F.lit("shop.parts."), name, F.lit("_"), F.col("p_partkey").cast("string")).alias("tail"), name.alias("name"), file.alias("file"))
    area, leaf = F.lower("r_name"), F.lower("n_name")
    return places.select(F.concat_ws(".", F.lit("shop"), area, leaf).alias("tail"), leaf.alias("name"), F.concat(F.lit("src/"), area, F.lit("/"), leaf, F.lit(".py")).alias("file")).unionByName(parts)


def mentions_of_parts(spark, d):
    return X.mentions(part_pages(spark, d), "page", "text")


def bound_mentions(spark, d, said):
    """(m, is_file, step, anchors, match, key) of each mention that binds: files by what their paths contain (step 0), names by steps 1 to 4."""
    files = facts(spark, d).nodes.select("file")
    found = L.substring_join(said.where("kind = 'file'"), "mention", files, "file")
    files_of = found.groupBy("m").agg(F.count(F.lit(1)).alias("anchors"), F.min("match").alias("match"))
    names = L.bind_in_steps(said.where("kind <> 'file'").select(F.col("mention").alias("m")).distinct(), symbols(spark, d))
    of_files = files_of.select("m", F.lit(True).alias("is_file"), F.lit(0).alias("step"), "anchors", "match", F.col("m").alias("key"))
    return of_files.unionByName(names.withColumn("is_file", F.lit(False)))


@query("j27_bind_mentions", f"{BOUND} SELECT m, step, anchors, match FROM bound")
def j27(spark, d):
    """Every mention with the first step that finds files or symbols for it, their number and the first of them."""
    return bound_mentions(spark, d, mentions_of_parts(spark, d)).select("m", "step", "anchors", "match")


def reviewed(spark, d):
    """Every mention of every page, bound or not, and whether it counts against its page."""
    said = mentions_of_parts(spark, d)
    bound = bound_mentions(spark, d, said)
    rows = said.join(bound, (F.col("m") == F.col("mention")) & (F.col("is_file") == (F.col("kind") == "file")), "left")
    claims = X.can_drift(F.col("kind"), F.col("mention"))
    return rows.select("page", "mention", "kind", F.coalesce("step", F.lit(-1)).alias("step"), F.coalesce("anchors", F.lit(0)).alias("anchors"), "match", "key", (F.col("step").isNull() & claims).alias("drifts"), claims.alias("claims"))


@query("j26_link_docs", f"{REVIEWED} SELECT DISTINCT page, match AS symbol FROM reviewed WHERE step > 0 AND anchors = 1")
def j26(spark, d):
    """Pages and the symbols that they name unmistakably: a mention of several symbols, or of a file, is no link."""
    return reviewed(spark, d).where("step > 0 AND anchors = 1").select("page", F.col("match").alias("symbol")).distinct()


@query("j28_doc_drift", f"{REVIEWED} SELECT page, mention, kind, anchors, drifts FROM reviewed")
def j28(spark, d):
    """All bindings; what claims to be code and binds to nothing drifts."""
    return reviewed(spark, d).select("page", "mention", "kind", "anchors", "drifts")


@query("j29_repo_drift", f"{REVIEWED} SELECT page, mention, 'names `' || mention || '`, and there is no such ' || CASE kind WHEN 'file' THEN 'file' ELSE 'symbol' END AS message FROM reviewed WHERE drifts")
def j29(spark, d):
    """A finding for each claim of the documents that the code doesn't support."""
    what = F.when(F.col("kind") == "file", "file").otherwise("symbol")
    message = F.concat(F.lit("names `"), "mention", F.lit("`, and there is no such "), what)
    return reviewed(spark, d).where("drifts").select("page", "mention", message.alias("message"))


VERDICT = f"""{REVIEWED}, evidence AS (SELECT page, 'src/' || list_extract(string_split(text, 'src/'), 2)[:position('`' IN list_extract(string_split(text, 'src/'), 2)) - 1] AS file FROM ({PAGES}) WHERE page % 2 = 0)
    SELECT page, CASE WHEN bool_or(anchors > 0) THEN 'bound' WHEN bool_or(claims) THEN 'unbound' ELSE 'no claim' END AS verdict, count(*) FILTER (drifts) AS unresolved,
        bool_or(EXISTS (SELECT 1 FROM anchor a JOIN evidence e ON e.file = a.file WHERE a.m = r.mention AND a.is_file = (r.kind = 'file') AND e.page = r.page)) AS in_evidence
    FROM reviewed r GROUP BY page"""


@query("j42_bind_criteria", VERDICT)
def j42(spark, d):
    """Each page as a criterion: bound by any mention, unbound if it only claims, and whether an anchor lies in its evidence.

    Every second page has the file it names under src/ as evidence. An anchor in it is looked
    for by (step, key, file), so a name that many symbols bear is never spread out.
    """
    pages, rows = part_pages(spark, d), reviewed(spark, d)
    evidence = pages.where("page % 2 = 0").select("page", F.regexp_extract("text", "`(src/[^`]*)`", 1).alias("file"))
    files = facts(spark, d).nodes.select(F.col("file").alias("f")).where("f IS NOT NULL").distinct()
    held = rows.where("anchors > 0").join(evidence, "page")
    by_file = held.where("step = 0").where(F.contains("file", F.col("mention"))).join(files, F.col("file") == F.col("f"), "left_semi").select("page")
    homes = L.step_keys(symbols(spark, d)).select("step", "key", "file").distinct()
    by_symbol = held.where("step > 0").join(homes, ["step", "key", "file"], "left_semi").select("page")
    there = by_file.unionByName(by_symbol).distinct().withColumn("there", F.lit(True))
    verdict = F.when(F.max(F.col("anchors") > 0), "bound").when(F.max("claims"), "unbound").otherwise("no claim")
    judged = rows.groupBy("page").agg(verdict.alias("verdict"), F.count_if("drifts").alias("unresolved"))
    return judged.join(there, "page", "left").select("page", "verdict", "unresolved", F.coalesce("there", F.lit(False)).alias("in_evidence"))


# --- intents, routes, traces


BLAME = "SELECT 'src/parts/p' || CAST(l_partkey % 40 AS STRING) || '.py' AS file, CAST(l_linenumber * 9 AS BIGINT) AS line, 'T-' || CAST(l_orderkey % 30 AS STRING) AS issue FROM lineitem"


INTENTS = f"SELECT DISTINCT n.id AS symbol, b.issue FROM nodes n JOIN ({BLAME}) b ON b.file = n.file AND b.line BETWEEN n.line AND coalesce(n.end_line, n.line) WHERE n.kind = 'Function'"


@query("j30_intents", graph=INTENTS)
def j30(spark, d):
    blame = table(spark, d, "lineitem").select(F.concat(F.lit("src/parts/p"), (F.col("l_partkey") % 40).cast("string"), F.lit(".py")).alias("file"), (F.col("l_linenumber") * 9).cast("long").alias("at_line"), F.concat(F.lit("T-"), (F.col("l_orderkey") % 30).cast("string")).alias("issue")).distinct()
    spans = facts(spark, d).nodes.where("kind = 'Function'").select("id", "file", "line", F.coalesce("end_line", "line").alias("last"))
    return blame.join(spans, "file").where(F.col("at_line").between(F.col("line"), F.col("last"))).select(F.col("id").alias("symbol"), "issue").distinct()


@query("j31_http_calls", f"SELECT p.page_id, e.event_type FROM pages p JOIN (SELECT DISTINCT event_type FROM events) e ON 'GET /' || e.event_type = 'GET /' || CASE p.page_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'nothing' END")
def j31(spark, d):
    calls = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, "view").when(F.col("page_id") % 4 == 1, "click").otherwise("nothing").alias("path"))
    routes = table(spark, d, "events").select("event_type").distinct().select("event_type", F.concat(F.lit("GET /"), "event_type").alias("route"))
    return calls.withColumn("route", F.concat(F.lit("GET /"), "path")).join(routes, "route").select("page_id", "event_type")


@query("j32_mounted_routes", "SELECT n_name, coalesce('/' || r_name, '') || '/' || n_name || '/items' AS path FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey UNION ALL SELECT n_name, '/v2/' || n_name || '/items' FROM nation WHERE n_nationkey % 5 = 0")
def j32(spark, d):
    """A route under each mount of its router; one without a mount stands at the root."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region").where("r_regionkey < 3")
    mounts = region.select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("/"), "r_name").alias("mount"))
    one = nation.join(mounts, "n_regionkey", "left").select("n_name", F.concat(F.coalesce("mount", F.lit("")), F.lit("/"), "n_name", F.lit("/items")).alias("path"))
    return one.unionByName(nation.where("n_nationkey % 5 = 0").select("n_name", F.concat(F.lit("/v2/"), "n_name", F.lit("/items")).alias("path")))


@query("j33_orm_references", "SELECT a.c_custkey, max(b.c_custkey) AS target FROM customer a JOIN customer b ON b.c_name = 'Customer#' || right('000000000' || CAST(a.c_custkey % 90 AS STRING), 9) AND b.c_custkey <> a.c_custkey GROUP BY 1")
def j33(spark, d):
    c = table(spark, d, "customer")
    refs = c.select("c_custkey", F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") % 90).cast("string"), 9, "0")).alias("c_name"))
    last = c.groupBy("c_name").agg(F.max("c_custkey").alias("target"))
    return refs.join(last, "c_name").where("target <> c_custkey").select("c_custkey", "target")


FRAMES = "SELECT event_id, user_id % 3 AS pos, 'p' || CAST(user_id % 40 AS STRING) || '.py' AS base, user_id % 90 + 1 AS line FROM events WHERE event_type = 'error'"


@query("j37_resolve_frames", graph=f"SELECT f.event_id, arg_min(n.id, (n.end_line - n.line) * 1000000000000 + n.seq) AS symbol FROM ({FRAMES}) f JOIN nodes n ON n.kind = 'Function' AND list_extract(string_split(n.file, '/'), -1) = f.base AND f.line BETWEEN n.line AND n.end_line GROUP BY 1")
def j37(spark, d):
    u = F.col("user_id")
    frames = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.concat(F.lit("p"), (u % 40).cast("string"), F.lit(".py")).alias("file"), (u % 90 + 1).alias("line"))
    spans = facts(spark, d).nodes.where("kind = 'Function'").select("id", F.substring_index("file", "/", -1).alias("file"), F.col("line").alias("first"), F.col("end_line").alias("last"), "seq")
    inside = frames.join(N.innermost_spans(frames, spans), ["file", "line"])
    return inside.groupBy("event_id").agg(F.min("best").alias("best")).select("event_id", F.col("best.id").alias("symbol"))


@query("j38_localize", graph=f", fault AS (SELECT f.event_id, arg_min(n.id, (n.end_line - n.line) * 1000000000000 + n.seq) AS symbol FROM ({FRAMES}) f JOIN nodes n ON n.kind = 'Function' AND list_extract(string_split(n.file, '/'), -1) = f.base AND f.line BETWEEN n.line AND n.end_line GROUP BY 1) SELECT f.symbol, count(DISTINCT f.event_id) AS traces, count(DISTINCT e.src) AS callers FROM fault f LEFT JOIN edges e ON e.dst = f.symbol AND e.kind = 'CALLS' GROUP BY 1")
def j38(spark, d):
    """Faulty symbols with the traces that end in them and their callers."""
    fault = write_once(j37(spark, d).groupBy("symbol").agg(F.count("*").alias("traces")))
    calls = N.edges_of_kind(facts(spark, d), "CALLS").select(F.col("dst").alias("symbol"), "src").join(fault, "symbol", "left_semi")  # of faulty symbols only
    callers = calls.groupBy("symbol").agg(F.count_distinct("src").alias("callers"))
    return fault.join(callers, "symbol", "left").fillna(0, ["callers"])


@query("j39_stated_files", graph="SELECT DISTINCT p.page_id, n.file FROM pages p JOIN (SELECT DISTINCT file, list_extract(string_split(file, '/'), -1) AS base FROM nodes WHERE file LIKE 'src/parts/%') n ON n.base = 'p' || CAST(p.page_id % 40 AS STRING) || '.py'")
def j39(spark, d):
    files = facts(spark, d).nodes.where("file LIKE 'src/parts/%'").select("file", F.substring_index("file", "/", -1).alias("base")).distinct()
    said = table(spark, d, "pages").select("page_id", F.concat(F.lit("see p"), (F.col("page_id") % 40).cast("string"), F.lit(".py for more")).alias("t"))
    named = said.select("page_id", F.explode(F.regexp_extract_all("t", F.lit(r"[\w/]+\.py"), F.lit(0))).alias("base"))
    return named.join(files, "base").select("page_id", "file").distinct()


@query("j40_match_modules", graph="SELECT r.k, arg_min(n.id, (CASE WHEN n.name = r.k THEN 0 ELSE 1 END) * 1000000 + n.seq) AS id FROM (SELECT unnest(['asia', 'nation_3', 'nation_7', 'africa.nation_0', 'zzz']) AS k) r JOIN nodes n ON n.kind = 'Module' AND (n.name = r.k OR list_extract(string_split(n.name, '.'), -1) = r.k) GROUP BY 1")
def j40(spark, d):
    asked = spark.createDataFrame([(k,) for k in ("asia", "nation_3", "nation_7", "africa.nation_0", "zzz")], "k string")
    mods = facts(spark, d).nodes.where("kind = 'Module'").select("id", "name", "seq")
    ways = mods.select(F.col("name").alias("k"), "id", "seq", F.lit(0).alias("rank")).unionByName(mods.select(F.substring_index("name", ".", -1).alias("k"), "id", "seq", F.lit(1).alias("rank")))
    return asked.join(ways, "k").groupBy("k").agg(F.min_by("id", F.struct("rank", "seq")).alias("id"))


@query("j41_file_blast_radius", graph="SELECT m.id, count(DISTINCT e.src) AS importers FROM nodes m LEFT JOIN edges e ON e.dst = m.id AND e.kind = 'IMPORTS' AND e.src <> m.id WHERE m.kind = 'Module' AND m.file LIKE 'src/a%' GROUP BY 1")
def j41(spark, d):
    g = facts(spark, d)
    importers = N.edges_of_kind(g, "IMPORTS").where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("importers"))
    return g.nodes.where("kind = 'Module' AND file LIKE 'src/a%'").select("id").join(importers, "id", "left").fillna(0, ["importers"])


REFERENCES = "SELECT k FROM (SELECT DISTINCT 'order_' || CAST(o_orderkey * 2 AS STRING) AS k FROM orders) WHERE k NOT IN (SELECT name FROM nodes)"


@query("j43_design_references", graph=REFERENCES)
def j43(spark, d):
    refs = table(spark, d, "orders").select(F.concat(F.lit("order_"), (F.col("o_orderkey") * 2).cast("string")).alias("k")).distinct()
    return refs.join(facts(spark, d).nodes.select(F.col("name").alias("k")), "k", "left_anti")


@query("j44_schema_diff", "SELECT t, c FROM (SELECT 'part' AS t, unnest(['P_PARTKEY', 'p_name', 'p_gone']) AS c UNION ALL SELECT 'missing', 'x') WHERE (t, lower(c)) NOT IN (SELECT 'part', unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']))")
def j44(spark, d):
    expected = spark.createDataFrame([("part", "P_PARTKEY"), ("part", "p_name"), ("part", "p_gone"), ("missing", "x")], "t string, c string")
    applied = spark.createDataFrame([("part", c) for c in table(spark, d, "part").columns], "t string, k string")
    return expected.withColumn("k", F.lower("c")).join(applied, ["t", "k"], "left_anti").select("t", "c")


# --- mappings by similarity


TYPE_TOKENS = f"SELECT id, {IDENT_TOKENS} AS tokens FROM nodes WHERE kind = 'Type'"
CLASSES = "SELECT DISTINCT c_mktsegment || ' ' || CASE c_nationkey % 3 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' ELSE 'Customer' END AS name FROM customer"


def classes(spark, d):
    kind = F.when(F.col("c_nationkey") % 3 == 0, "Controller").when(F.col("c_nationkey") % 3 == 1, "Service").otherwise("Customer")
    return table(spark, d, "customer").select(F.concat_ws(" ", "c_mktsegment", kind).alias("name")).distinct()


SIMILAR = f""", a AS ({TYPE_TOKENS}), b AS (SELECT name AS target, {IDENT_TOKENS} AS tokens FROM ({CLASSES})),
    s AS (SELECT id, target, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) AS score FROM a, b WHERE len(list_intersect(a.tokens, b.tokens)) > 0)
    SELECT id, target, round(score, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, target) AS place FROM s WHERE score >= 0.3) WHERE place <= 3"""


def tokens_of_types(spark, d):
    return facts(spark, d).nodes.where("kind = 'Type'").select("id", X.identifier_tokens(F.col("name")).alias("tokens"))


@query("j45_propose_mappings", graph=SIMILAR)
def j45(spark, d):
    right = classes(spark, d).select(F.col("name").alias("target"), X.identifier_tokens(F.col("name")).alias("tokens"))
    return L.similarity_top_k(tokens_of_types(spark, d), right, 3, 0.3).withColumn("score", F.round("score", 9))


@query("j46_mapping_scores", f"SELECT a.p_name AS a, b.c AS b, CASE WHEN a.p_name = b.c THEN 1.0 WHEN list_sort(string_split(a.p_name, ' ')) = list_sort(string_split(b.c, ' ')) THEN 0.9 ELSE round(len(list_intersect(string_split(a.p_name, ' '), string_split(b.c, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.c, ' ')))), 2) END AS score FROM (SELECT DISTINCT p_name FROM part) a, (SELECT unnest(['red widget', 'widget red', 'small blue ring']) AS c) b WHERE len(list_intersect(string_split(a.p_name, ' '), string_split(b.c, ' '))) > 0")
def j46(spark, d):
    b = spark.createDataFrame([(c,) for c in ("red widget", "widget red", "small blue ring")], "b string")
    index = b.select("b", F.explode(F.split("b", " ")).alias("w"))
    names = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct().select("a", F.explode(F.split("a", " ")).alias("w"))
    pairs = names.join(F.broadcast(index), "w").select("a", "b").distinct()
    wa, wb = F.split("a", " "), F.split("b", " ")
    same = F.array_sort(wa) == F.array_sort(wb)
    score = F.when(F.col("a") == F.col("b"), F.lit(1.0)).when(same, F.lit(0.9)).otherwise(F.round(X.jaccard(wa, wb), 2))
    return pairs.select("a", "b", score.alias("score"))


@query("w09_relevant_symbols", graph=f", q AS (SELECT ['small', 'ring', 'red', 'controller'] AS w), t AS (SELECT id, {IDENT_TOKENS} AS tokens FROM nodes WHERE kind IN ('Type', 'Function') AND {G.GROUNDED} AND NOT {G.TEST_SQL}) SELECT id, round(3.0 * len(list_intersect(tokens, w)) / len(tokens) + len(list_intersect(tokens, w)) + 0.5, 6) AS score FROM t, q WHERE len(list_intersect(tokens, w)) > 0 ORDER BY score DESC, id LIMIT 8")
def w09(spark, d):
    wanted = F.array(*[F.lit(w) for w in ("small", "ring", "red", "controller")])
    rows = facts(spark, d).nodes.where("kind IN ('Type', 'Function')").where(N.grounded() & ~G.is_test()).select("id", X.identifier_tokens(F.col("name")).alias("t"))
    both = F.size(F.array_intersect("t", wanted))
    return rows.where(both > 0).select("id", F.round(3.0 * both / F.size("t") + both + 0.5, 6).alias("score")).orderBy(F.desc("score"), "id").limit(8)


@query("w10_diff_impact", graph=f"SELECT s.symbol, count(e.src) AS callers FROM (SELECT DISTINCT symbol FROM ({G.ENCLOSING}) WHERE file IN ('src/parts/p3.py', 'src/parts/p4.py')) s LEFT JOIN edges e ON e.dst = s.symbol AND e.kind = 'CALLS' GROUP BY 1 ORDER BY callers DESC, symbol")
def w10(spark, d):
    g = facts(spark, d)
    spots = G.spots(spark, d).where("file IN ('src/parts/p3.py', 'src/parts/p4.py')")
    symbols = N.enclosing_symbols(spots, g.nodes.where("kind IN ('Type', 'Function', 'Field', 'Endpoint')")).select("symbol").distinct()
    callers = N.edges_of_kind(g, "CALLS").groupBy(F.col("dst").alias("symbol")).agg(F.count("*").alias("callers"))
    return symbols.join(callers, "symbol", "left").fillna(0, ["callers"]).orderBy(F.desc("callers"), "symbol")


@query("j54_review_grounding", graph=f"SELECT x.symbol, x.line, count(DISTINCT e.src) AS callers FROM (SELECT symbol, min(line) AS line FROM ({G.ENCLOSING}) GROUP BY 1) x JOIN nodes s ON s.id = x.symbol LEFT JOIN edges e ON e.dst = x.symbol AND e.kind = 'CALLS' AND e.src IN (SELECT id FROM nodes c WHERE c.file IS NOT NULL AND c.kind = 'Type') GROUP BY 1, 2")
def j54(spark, d):
    g = facts(spark, d)
    hit = N.enclosing_symbols(G.spots(spark, d), g.nodes.where("kind IN ('Type', 'Function', 'Field', 'Endpoint')")).groupBy("symbol").agg(F.min("line").alias("line"))
    known = g.nodes.where("kind = 'Type' AND file IS NOT NULL").select(F.col("id").alias("src"))
    callers = N.edges_of_kind(g, "CALLS").join(known, "src", "left_semi").groupBy(F.col("dst").alias("symbol")).agg(F.count_distinct("src").alias("callers"))
    return hit.join(callers, "symbol", "left").fillna(0, ["callers"])


@query("j55_stale_facts", graph=f"SELECT file, id FROM nodes WHERE kind = 'Function' AND {G.GROUNDED} AND id NOT IN (SELECT id FROM nodes WHERE seq % 7 <> 0)")
def j55(spark, d):
    nodes = facts(spark, d).nodes
    return nodes.where("kind = 'Function'").where(N.grounded()).join(nodes.where("seq % 7 <> 0").select("id"), "id", "left_anti").select("file", "id")


@query("j56_api_surface", graph="SELECT m.id AS module, c.id AS child FROM nodes m JOIN edges e ON e.src = m.id AND e.kind = 'CONTAINS' JOIN nodes c ON c.id = e.dst AND c.kind IN ('Type', 'Function') WHERE m.kind = 'Module' AND m.name LIKE 'asia%'")
def j56(spark, d):
    g = facts(spark, d)
    mods = g.nodes.where("kind = 'Module' AND name LIKE 'asia%'").select(F.col("id").alias("src"))
    kids = g.nodes.where("kind IN ('Type', 'Function')").select(F.col("id").alias("dst"))
    return N.edges_of_kind(g, "CONTAINS").join(mods, "src", "left_semi").join(kids, "dst", "left_semi").select(F.col("src").alias("module"), F.col("dst").alias("child"))


@query("j62_score_findings")
def j62(spark, d):
    li = table(spark, d, "lineitem")
    rows = lambda flag: li.where(F.col("l_returnflag") == flag).select((F.col("l_suppkey")).cast("string").alias("file"), (F.col("l_orderkey") % 400).alias("line"))
    return L.greedy_band_match(rows("R"), rows("A"))


@query("j63_review_submission", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 AND (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') THEN 'inline' ELSE 'floating' END AS place FROM lineitem WHERE l_discount >= 0.08")
def j63(spark, d):
    li = table(spark, d, "lineitem")
    anchors = li.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.lit(True).alias("anchored")).distinct()
    rows = li.where("l_discount >= 0.08").join(anchors, ["l_orderkey", "l_linenumber"], "left")
    return rows.select("l_orderkey", "l_linenumber", F.when((F.col("l_linenumber") <= 3) & F.coalesce("anchored", F.lit(False)), "inline").otherwise("floating").alias("place"))


@query("j66_evidence", graph="SELECT n.id, (SELECT count(*) FROM edges e WHERE e.dst = n.id AND e.kind = 'EXPOSES') AS served, (SELECT count(*) FROM edges e WHERE e.src = n.id AND e.kind = 'CONSUMES') AS called, (SELECT count(*) FROM edges e WHERE e.dst = n.id AND e.kind = 'MENTIONS') AS docs FROM nodes n WHERE n.kind = 'Function' AND n.file IN ('src/parts/p1.py', 'src/parts/p7.py')")
def j66(spark, d):
    g = facts(spark, d)
    own = g.nodes.where("kind = 'Function' AND file IN ('src/parts/p1.py', 'src/parts/p7.py')").select("id")
    end = F.when(F.col("kind") == "CONSUMES", F.col("src")).otherwise(F.col("dst"))
    n = N.edges_of_kind(g, "EXPOSES", "CONSUMES", "MENTIONS").groupBy(end.alias("id")).agg(
        F.count_if(F.col("kind") == "EXPOSES").alias("served"), F.count_if(F.col("kind") == "CONSUMES").alias("called"), F.count_if(F.col("kind") == "MENTIONS").alias("docs")
    )
    return own.join(n, "id", "left").fillna(0, ["served", "called", "docs"])


@query("w24_greedy_budget", """WITH RECURSIVE b AS (SELECT l_orderkey AS g, CAST(l_linenumber AS BIGINT) AS rank, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS r FROM lineitem),
    f AS (SELECT DISTINCT g, 0::BIGINT AS r, 0::BIGINT AS used, NULL::BIGINT AS rank, NULL::BOOLEAN AS kept FROM b
        UNION ALL SELECT f.g, b.r, CASE WHEN used + size <= 60 THEN used + size ELSE used END, b.rank, used + size <= 60 FROM f JOIN b ON b.g = f.g AND b.r = f.r + 1)
    SELECT g AS "group", rank, kept FROM f WHERE r > 0""")
def w24(spark, d):
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").cast("long").alias("rank"), F.col("l_quantity").cast("long").alias("size"))
    return L.greedy_pack(blocks, 60)


@query("w23_investigation", graph=G.OWNER_SQL + f" SELECT n.id, o.module, count(e.src) AS callers FROM nodes n LEFT JOIN owner o ON o.id = n.id LEFT JOIN edges e ON e.dst = n.id AND e.kind = 'CALLS' WHERE n.kind = 'Function' AND n.name LIKE 'red_ring%' GROUP BY 1, 2")
def w23(spark, d):
    from ..operators.hierarchy import owning_modules

    g = facts(spark, d)
    hits = g.nodes.where("kind = 'Function' AND name LIKE 'red_ring%'").select("id")
    callers = N.edges_of_kind(g, "CALLS").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    return hits.join(owning_modules(g), "id", "left").join(callers, "id", "left").fillna(0, ["callers"]).select("id", "module", "callers")


@query("w22_hypotheses", "SELECT user_id, 'repeated error' AS hypothesis, 'high' AS confidence FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 14 UNION ALL SELECT user_id, 'no purchase', 'low' FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') = 0")
def w22(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    rules = F.array(
        F.when(F.col("e") > 14, F.struct(F.lit("repeated error").alias("hypothesis"), F.lit("high").alias("confidence"))),
        F.when(F.col("p") == 0, F.struct(F.lit("no purchase").alias("hypothesis"), F.lit("low").alias("confidence"))),
    )
    return per.select("user_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("user_id", "r.hypothesis", "r.confidence")
