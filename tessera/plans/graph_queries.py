"""Queries over the fact graph: lookups, neighbours, checks, counts, rankings, walks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import hierarchy as H
from ..operators import neighbours as N
from ..operators import traversal as T
from ..operators.communities import label_propagation
from ..sources.fact_tables import EDGE_KINDS, NODE_KINDS, facts
from .registry import query

GROUNDED = "(file IS NOT NULL AND NOT external)"


def nodes_(spark, d):
    return facts(spark, d).nodes


# --- lookups and predicates


@query("f01_node_by_id", graph="SELECT id, kind, name FROM nodes WHERE id = 'part:7'")
def f01(spark, d):
    return nodes_(spark, d).where("id = 'part:7'").select("id", "kind", "name")


@query("f02_find_by_name", graph=f"SELECT id, kind, {GROUNDED} AS grounded FROM nodes WHERE lower(name) = 'customer12controller'")
def f02(spark, d):
    return N.find(facts(spark, d), "Customer12Controller")


@query("f03_edges_of_kind", graph="SELECT src, dst, line FROM edges WHERE kind = 'IMPLEMENTS'")
def f03(spark, d):
    return N.edges_of_kind(facts(spark, d), "IMPLEMENTS").select("src", "dst", "line")


@query("f04_grounded", graph=f"SELECT kind, {GROUNDED} AS grounded, count(*) AS n FROM nodes GROUP BY 1, 2")
def f04(spark, d):
    return nodes_(spark, d).groupBy("kind", N.grounded().alias("grounded")).agg(F.count("*").alias("n"))


def is_public():
    """True, False, or NULL where the language says nothing."""
    last = F.element_at(F.split("name", r"\."), -1)
    return (
        F.when(F.col("language").isin("c", "cpp"), ~F.contains("name", F.lit("::")))
        .when(F.col("language") == "go", F.rlike(last, F.lit(r"^\p{Lu}")))
        .when(F.col("language").isin("py", "ts", "js"), ~F.exists(F.split("name", r"\."), lambda s: F.startswith(s, F.lit("_"))))
    )


PUBLIC_SQL = """CASE WHEN language IN ('c', 'cpp') THEN NOT contains(name, '::')
    WHEN language = 'go' THEN regexp_matches(list_extract(string_split(name, '.'), -1), '^\\p{Lu}')
    WHEN language IN ('py', 'ts', 'js') THEN NOT (starts_with(name, '_') OR contains(name, '._')) END"""


@query("f05_is_public", graph=f"SELECT id, {PUBLIC_SQL} AS is_public FROM nodes WHERE kind IN ('Type', 'Function', 'Module')")
def f05(spark, d):
    return nodes_(spark, d).where("kind IN ('Type', 'Function', 'Module')").select("id", is_public().alias("is_public"))


def is_test():
    """Test code by path or by name."""
    return F.coalesce(F.rlike("file", F.lit(r"(^|/)tests?/|(^|/)test_[^/]*$")), F.lit(False)) | F.startswith("name", F.lit("test_"))


TEST_SQL = r"(coalesce(regexp_matches(file, '(^|/)tests?/|(^|/)test_[^/]*$'), false) OR starts_with(name, 'test_'))"


@query("f06_is_test", graph=f"SELECT kind, {TEST_SQL} AS is_test, count(*) AS n FROM nodes GROUP BY 1, 2")
def f06(spark, d):
    return nodes_(spark, d).groupBy("kind", is_test().alias("is_test")).agg(F.count("*").alias("n"))


@query(
    "f07_test_files",
    graph="""SELECT DISTINCT file, list_contains(string_split(file, '/'), 'test') OR list_contains(string_split(file, '/'), 'tests')
             OR starts_with(list_extract(string_split(file, '/'), -1), 'test_') AS is_test FROM nodes WHERE file IS NOT NULL""",
)
def f07(spark, d):
    parts = F.split("file", "/")
    test = F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests"))) | F.startswith(F.element_at(parts, -1), F.lit("test_"))
    return nodes_(spark, d).where("file IS NOT NULL").select("file", test.alias("is_test")).distinct()


@query("f08_under_tests", graph="SELECT id FROM nodes WHERE starts_with(file, 'tests/') OR contains(file, '/tests/')")
def f08(spark, d):
    return nodes_(spark, d).where(F.startswith("file", F.lit("tests/")) | F.contains("file", F.lit("/tests/"))).select("id")


@query("f09_test_modules", graph=r"SELECT name, regexp_matches(name, '(^|\.)(tests?|test_\w+)(\.|$)') AS is_test FROM nodes WHERE kind = 'Module'")
def f09(spark, d):
    return nodes_(spark, d).where("kind = 'Module'").select("name", F.rlike("name", F.lit(r"(^|\.)(tests?|test_\w+)(\.|$)")).alias("is_test"))


GENERATED = r"(^|/)(node_modules|vendor|third_party|dist|build|generated|migrations|supply)(/|$)|_pb2\.py$|\.min\.js$|\.g\.cs$"


@query("f10_generated_paths", graph=f"SELECT DISTINCT file FROM nodes WHERE regexp_matches(file, '{GENERATED}')")
def f10(spark, d):
    return nodes_(spark, d).where(F.rlike("file", F.lit(GENERATED))).select("file").distinct()


@query("f11_test_areas", graph="SELECT DISTINCT string_split(file, '/')[1] AS zone, string_split(file, '/')[1] IN ('test', 'tests') AS is_test FROM nodes WHERE file IS NOT NULL")
def f11(spark, d):
    zone = H.zone_of(F.col("file"))
    return nodes_(spark, d).where("file IS NOT NULL").select(F.substring_index("file", "/", 1).alias("zone"), zone.isin("test", "tests").alias("is_test")).distinct()


@query("f12_frameworks", graph="SELECT name, string_split(name, '.')[1] IN ('asia', 'java', 'System') AS is_framework FROM nodes WHERE kind = 'Module'")
def f12(spark, d):
    return nodes_(spark, d).where("kind = 'Module'").select("name", F.substring_index("name", ".", 1).isin("asia", "java", "System").alias("is_framework"))


@query("f13_interfaces", graph="SELECT id, name FROM nodes WHERE kind = 'Type' AND regexp_matches(name, '^I[A-Z]')")
def f13(spark, d):
    return nodes_(spark, d).where("kind = 'Type'").where(F.rlike("name", F.lit("^I[A-Z]"))).select("id", "name")


@query("f26_count_of", graph="SELECT kind, count(*) AS n FROM nodes WHERE NOT external GROUP BY kind")
def f26(spark, d):
    return nodes_(spark, d).where("NOT external").groupBy("kind").agg(F.count("*").alias("n"))


def layer():
    name = F.col("name")
    return (
        F.when(name.endswith("Controller"), "controller")
        .when(name.endswith("Service"), "service")
        .when(name.endswith("Repository"), "data")
        .when(name.endswith("Error"), "error")
        .otherwise("domain")
    )


LAYER_SQL = """CASE WHEN name LIKE '%Controller' THEN 'controller' WHEN name LIKE '%Service' THEN 'service'
    WHEN name LIKE '%Repository' THEN 'data' WHEN name LIKE '%Error' THEN 'error' ELSE 'domain' END"""


@query("f28_layer", graph=f"SELECT id, {LAYER_SQL} AS layer FROM nodes WHERE kind = 'Type'")
def f28(spark, d):
    return nodes_(spark, d).where("kind = 'Type'").select("id", layer().alias("layer"))


# --- neighbours: (name, direction, kind)

_HOPS = [
    ("j01_callers_of", "incoming", "CALLS"),
    ("j02_callees_of", "outgoing", "CALLS"),
    ("j03_children_of", "outgoing", "CONTAINS"),
    ("j05_imports_of", "outgoing", "IMPORTS"),
    ("j06_importers_of", "incoming", "IMPORTS"),
    ("j08_exposers_of", "incoming", "EXPOSES"),
    ("j09_consumers_of", "incoming", "CONSUMES"),
    ("j10_endpoints_called_by", "outgoing", "CONSUMES"),
    ("j11_references_of", "outgoing", "REFERENCES"),
    ("j12_dependents_of", "incoming", "REFERENCES"),
    ("j13_implementors_of", "incoming", "IMPLEMENTS"),
    ("j14_implements_of", "outgoing", "IMPLEMENTS"),
    ("j15_docs_for", "incoming", "MENTIONS"),
    ("j16_mentions_of", "outgoing", "MENTIONS"),
]


def _hop(name, direction, kind):
    here, there = ("dst", "src") if direction == "incoming" else ("src", "dst")

    @query(
        name,
        graph=f"SELECT e.{here} AS node, e.{there} AS neighbour, n.name, e.line AS at_line FROM edges e JOIN nodes n ON n.id = e.{there} WHERE e.kind = '{kind}'",
    )
    def run(spark, d):
        return getattr(N, direction)(facts(spark, d), kind)


for _h in _HOPS:
    _hop(*_h)


@query("j04_parents_index", graph="SELECT dst AS child, arg_max(src, seq) AS parent FROM edges WHERE kind = 'CONTAINS' GROUP BY dst")
def j04(spark, d):
    return N.parents(facts(spark, d))


@query(
    "j07_touches",
    graph="""SELECT DISTINCT x.node, x.neighbour, n.name FROM (
        SELECT src AS node, dst AS neighbour FROM edges WHERE src IN ('part:7', 'nation:3', 'customer:12')
        UNION SELECT dst, src FROM edges WHERE dst IN ('part:7', 'nation:3', 'customer:12')) x JOIN nodes n ON n.id = x.neighbour""",
)
def j07(spark, d):
    return N.touches(facts(spark, d), ["part:7", "nation:3", "customer:12"])


SPOTS = "SELECT DISTINCT 'src/parts/p' || CAST(l_partkey % 40 AS STRING) || '.py' AS file, CAST(l_linenumber * 7 AS BIGINT) AS line FROM lineitem"


def spots(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(
        F.concat(F.lit("src/parts/p"), (F.col("l_partkey") % 40).cast("string"), F.lit(".py")).alias("file"), (F.col("l_linenumber") * 7).cast("long").alias("line")
    ).distinct()


ENCLOSING = f"""SELECT s.file, s.line, arg_min(n.id, (n.end_line - n.line) * 1000000000000 + n.seq) AS symbol
    FROM ({SPOTS}) s JOIN nodes n ON n.file = s.file AND s.line BETWEEN n.line AND coalesce(n.end_line, n.line)
    WHERE n.kind IN ('Type', 'Function', 'Field', 'Endpoint') GROUP BY 1, 2"""


@query("j17_enclosing_symbol", graph=ENCLOSING)
def j17(spark, d):
    return N.enclosing_symbols(spots(spark, d), nodes_(spark, d).where("kind IN ('Type', 'Function', 'Field', 'Endpoint')"))


@query("j18_symbols_at", graph=f"SELECT DISTINCT symbol FROM ({ENCLOSING}) WHERE file = 'src/parts/p3.py'")
def j18(spark, d):
    found = N.enclosing_symbols(spots(spark, d).where("file = 'src/parts/p3.py'"), nodes_(spark, d).where("kind IN ('Type', 'Function', 'Field', 'Endpoint')"))
    return found.select("symbol").distinct()


@query(
    "j19_cross_file_callers",
    graph="""SELECT t.id AS symbol, c.id AS caller, e.line AS at_line FROM edges e JOIN nodes t ON t.id = e.dst JOIN nodes c ON c.id = e.src
             WHERE e.kind = 'CALLS' AND c.file IS NOT NULL AND t.file IS NOT NULL AND c.file <> t.file AND t.kind = 'Function'""",
)
def j19(spark, d):
    g = facts(spark, d)
    sites = N.incoming(g, "CALLS").select(F.col("node").alias("symbol"), F.col("neighbour").alias("caller"), "at_line")
    file_of = lambda k: g.nodes.select(F.col("id").alias(k), F.col("file").alias(f"{k}_file"), F.col("kind").alias(f"{k}_kind"))
    return (
        sites.join(file_of("symbol").where("symbol_kind = 'Function'"), "symbol")
        .join(file_of("caller"), "caller")
        .where("caller_file <> symbol_file")
        .select("symbol", "caller", "at_line")
    )


# --- consistency checks


@query(
    "c01_dangling_edges",
    graph="SELECT src, dst, kind, line FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)",
)
def c01(spark, d):
    g = facts(spark, d)
    ids = g.nodes.select("id")
    no_src = g.edges.join(ids, F.col("src") == F.col("id"), "left_anti")
    no_dst = g.edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_anti")
    return no_src.unionByName(no_dst).select("src", "dst", "kind", "line")


@query(
    "c02_bad_provenance",
    graph=f"""SELECT n.id, n.file, n.line FROM nodes n LEFT JOIN (SELECT file, max(line) AS lines FROM edges GROUP BY file) f ON f.file = n.file
              WHERE {GROUNDED.replace('file', 'n.file').replace('external', 'n.external')} AND n.file NOT LIKE 'db://%' AND (f.file IS NULL OR n.line < 1 OR n.line > greatest(f.lines, 1)) AND n.kind = 'Function'""",
)
def c02(spark, d):
    g = facts(spark, d)
    lines = g.edges.groupBy("file").agg(F.max("line").alias("lines"))
    own = g.nodes.where("kind = 'Function'").where(N.grounded()).where(~F.col("file").startswith("db://"))
    joined = own.join(lines, "file", "left")
    return joined.where(F.col("lines").isNull() | (F.col("line") < 1) | (F.col("line") > F.greatest("lines", F.lit(1)))).select("id", "file", "line")


@query(
    "c03_phantom_modules",
    graph="""SELECT e.id FROM nodes e WHERE e.kind = 'Module' AND e.external AND EXISTS (SELECT 1 FROM nodes f WHERE f.kind = 'Module' AND NOT f.external
             AND f.language = e.language AND left(list_extract(string_split(f.name, '.'), -1), 8) = left(list_extract(string_split(e.name, '.'), -1), 8))""",
)
def c03(spark, d):
    mods = nodes_(spark, d).where("kind = 'Module'").withColumn("base", F.substring(F.substring_index("name", ".", -1), 1, 8))
    return mods.where("external").join(mods.where("NOT external").select("language", "base"), ["language", "base"], "left_semi").select("id")


@query(
    "c08_dead_code",
    graph=f"""SELECT id FROM nodes n WHERE kind IN ('Type', 'Function') AND {GROUNDED} AND NOT {TEST_SQL} AND NOT starts_with(name, '__') AND ({PUBLIC_SQL}) = false
              AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id AND e.kind IN ('CALLS', 'IMPLEMENTS', 'MENTIONS'))""",
)
def c08(spark, d):
    g = facts(spark, d)
    considered = g.nodes.where("kind IN ('Type', 'Function')").where(N.grounded() & ~is_test() & ~F.startswith("name", F.lit("__")) & (is_public() == F.lit(False)))
    used = N.edges_of_kind(g, "CALLS", "IMPLEMENTS", "MENTIONS").select(F.col("dst").alias("id"))
    return considered.join(used, "id", "left_anti").select("id")


@query(
    "c04_rates",
    graph="""SELECT language, count(*) AS modules, sum((NOT has_owner)::BIGINT) AS orphans, sum(has_owner::BIGINT) > 0 AS any_owned FROM (
        SELECT n.language, EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CONTAINS' AND e.dst = n.id) AS has_owner FROM nodes n WHERE n.kind = 'Type')
        GROUP BY language HAVING count(*) >= 8""",
)
def c04(spark, d):
    g = facts(spark, d)
    owned = N.edges_of_kind(g, "CONTAINS").select(F.col("dst").alias("id"), F.lit(True).alias("o")).distinct()
    types = g.nodes.where("kind = 'Type'").join(owned, "id", "left").withColumn("o", F.coalesce("o", F.lit(False)))
    return (
        types.groupBy("language")
        .agg(F.count("*").alias("modules"), F.count_if(~F.col("o")).alias("orphans"), F.bool_or("o").alias("any_owned"))
        .where("modules >= 8")
    )


@query("k07_dangling_ids", graph="SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM nodes)")
def k07(spark, d):
    g = facts(spark, d)
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(g.nodes.select("id"), "id", "left_anti")


@query("c07_verify", graph="""SELECT rule, count(*) AS n FROM (
    SELECT 'dangling' AS rule FROM edges WHERE src NOT IN (SELECT id FROM nodes)
    UNION ALL SELECT 'external-module' FROM nodes WHERE kind = 'Module' AND external
    UNION ALL SELECT 'no-provenance' FROM nodes WHERE file IS NULL AND NOT external) GROUP BY rule""")
def c07(spark, d):
    g = facts(spark, d)
    rules = [
        g.edges.join(g.nodes.select("id"), F.col("src") == F.col("id"), "left_anti").select(F.lit("dangling").alias("rule")),
        g.nodes.where("kind = 'Module' AND external").select(F.lit("external-module").alias("rule")),
        g.nodes.where("file IS NULL AND NOT external").select(F.lit("no-provenance").alias("rule")),
    ]
    found = rules[0].unionByName(rules[1]).unionByName(rules[2])
    return found.groupBy("rule").agg(F.count("*").alias("n"))


# --- dedup and counts


@query(
    "d01_node_dedup",
    graph=f"""SELECT id, kind, grounded FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY grounded DESC, seq) AS rn FROM (
        SELECT 'f:' || coalesce(file, '') AS id, kind, {GROUNDED} AS grounded, seq FROM nodes)) WHERE rn = 1""",
)
def d01(spark, d):
    rows = nodes_(spark, d).select(F.concat(F.lit("f:"), F.coalesce("file", F.lit(""))).alias("id"), "kind", N.grounded().alias("grounded"), "seq")
    best = rows.groupBy("id").agg(F.min_by(F.struct("kind", "grounded"), F.struct(~F.col("grounded"), F.col("seq"))).alias("v"))
    return best.select("id", "v.kind", "v.grounded")


@query(
    "d02_edge_dedup",
    graph="SELECT src, dst, kind, coalesce(file, 'None') || ':' || CAST(line % 5 AS STRING) AS place, min(seq) AS seq FROM edges WHERE kind IN ('CALLS', 'READS') GROUP BY 1, 2, 3, 4",
)
def d02(spark, d):
    place = F.concat_ws(":", F.coalesce("file", F.lit("None")), (F.col("line") % 5).cast("string"))
    return N.edges_of_kind(facts(spark, d), "CALLS", "READS").groupBy("src", "dst", "kind", place.alias("place")).agg(F.min("seq").alias("seq"))


@query(
    "d03_merge",
    graph="SELECT id, min(seq) AS seq FROM (SELECT id, seq FROM nodes WHERE kind = 'Type' UNION ALL SELECT id, seq + 1 FROM nodes WHERE kind IN ('Type', 'Module')) GROUP BY id",
)
def d03(spark, d):
    n = nodes_(spark, d)
    both = n.where("kind = 'Type'").select("id", "seq").unionByName(n.where("kind IN ('Type', 'Module')").select("id", (F.col("seq") + 1).alias("seq")))
    return both.groupBy("id").agg(F.min("seq").alias("seq"))


@query("d04_counts", graph="SELECT kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT kind, count(*) FROM edges GROUP BY kind")
def d04(spark, d):
    g = facts(spark, d)
    return g.nodes.select("kind").unionByName(g.edges.select("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_ZERO = " UNION ALL ".join(f"SELECT '{k}' AS kind" for k in EDGE_KINDS)


@query(
    "d05_summary",
    graph=f"""SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'grounded', count(*) FROM nodes WHERE {GROUNDED}
        UNION ALL SELECT 'external', count(*) FROM nodes WHERE external UNION ALL SELECT 'edges', count(*) FROM edges
        UNION ALL SELECT k.kind, count(e.src) FROM ({_ZERO}) k LEFT JOIN edges e ON e.kind = k.kind GROUP BY k.kind""",
)
def d05(spark, d):
    g = facts(spark, d)
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_if(N.grounded()).alias("grounded"), F.count_if("external").alias("external"))
    by_kind = g.edges.groupBy("kind").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([(k,) for k in EDGE_KINDS], "kind string").join(by_kind, "kind", "left")
    return (
        n.selectExpr("stack(3, 'nodes', nodes, 'grounded', grounded, 'external', external) AS (what, n)")
        .unionByName(by_kind.agg(F.lit("edges").alias("what"), F.sum("n").alias("n")))
        .unionByName(kinds.select(F.col("kind").alias("what"), F.coalesce("n", F.lit(0)).alias("n")))
    )


@query(
    "d06_hotspots",
    graph="""SELECT e.dst AS id, t.name, count(*) AS calls FROM edges e JOIN nodes c ON c.id = e.src JOIN nodes t ON t.id = e.dst
             WHERE e.kind = 'CALLS' AND t.kind = 'Function' GROUP BY 1, 2 ORDER BY calls DESC, id LIMIT 10""",
)
def d06(spark, d):
    g = facts(spark, d)
    known = g.nodes.select(F.col("id").alias("src"))
    calls = N.edges_of_kind(g, "CALLS").join(known, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls"))
    return calls.join(g.nodes.where("kind = 'Function'").select("id", "name"), "id").select("id", "name", "calls").orderBy(F.desc("calls"), "id").limit(10)


@query(
    "d07_median_calls",
    graph="SELECT coalesce(median(n), 0.0) AS median_calls FROM (SELECT dst, count(*) AS n FROM edges WHERE kind = 'CALLS' GROUP BY dst)",
)
def d07(spark, d):
    n = N.edges_of_kind(facts(spark, d), "CALLS").groupBy("dst").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.median("n"), F.lit(0.0)).alias("median_calls"))


IMPORTANCE_SQL = f"""SELECT n.id, coalesce(i.prod, 0) AS prod_callers, coalesce(i.test, 0) AS test_callers, coalesce(i.impl, 0) AS implementors,
    coalesce(i.ment, 0) AS mentions, coalesce(o.members, 0) AS members,
    3 * coalesce(i.impl, 0) + 2 * coalesce(i.prod, 0) + 2 * coalesce(i.ment, 0) + coalesce(o.members, 0) AS score, n.name
    FROM nodes n LEFT JOIN (
        SELECT e.dst, count(*) FILTER (e.kind = 'CALLS' AND NOT s.t) AS prod, count(*) FILTER (e.kind = 'CALLS' AND s.t) AS test,
               count(*) FILTER (e.kind = 'IMPLEMENTS') AS impl, count(*) FILTER (e.kind = 'MENTIONS') AS ment
        FROM edges e JOIN (SELECT id, {TEST_SQL} AS t FROM nodes) s ON s.id = e.src GROUP BY e.dst) i ON i.dst = n.id
    LEFT JOIN (SELECT src, count(*) AS members FROM edges WHERE kind = 'CONTAINS' GROUP BY src) o ON o.src = n.id
    WHERE n.kind IN ('Type', 'Function')"""


def importance(g):
    """Counters of D08 and the score of D09: one aggregate over in-edges, one over out-edges."""
    test = g.nodes.select(F.col("id").alias("src"), is_test().alias("t"))
    call = F.col("kind") == "CALLS"
    into = (
        N.edges_of_kind(g, "CALLS", "IMPLEMENTS", "MENTIONS")
        .join(test, "src")
        .groupBy(F.col("dst").alias("id"))
        .agg(
            F.count_if(call & ~F.col("t")).alias("prod_callers"),
            F.count_if(call & F.col("t")).alias("test_callers"),
            F.count_if(F.col("kind") == "IMPLEMENTS").alias("implementors"),
            F.count_if(F.col("kind") == "MENTIONS").alias("mentions"),
        )
    )
    out = N.edges_of_kind(g, "CONTAINS").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("members"))
    counters = ["prod_callers", "test_callers", "implementors", "mentions", "members"]
    rows = g.nodes.where("kind IN ('Type', 'Function')").join(into, "id", "left").join(out, "id", "left").fillna(0, counters)
    score = 3 * F.col("implementors") + 2 * F.col("prod_callers") + 2 * F.col("mentions") + F.col("members")
    return rows.select("id", *counters, score.alias("score"), "name", "kind", "file")


@query("d08_importance_counters", graph=f"SELECT id, prod_callers, test_callers, implementors, mentions, members FROM ({IMPORTANCE_SQL})")
def d08(spark, d):
    return importance(facts(spark, d)).select("id", "prod_callers", "test_callers", "implementors", "mentions", "members")


@query("d09_importance_score", graph=f"SELECT id, score FROM ({IMPORTANCE_SQL})")
def d09(spark, d):
    return importance(facts(spark, d)).select("id", "score")


@query("d10_caller_split", graph=f"SELECT id, CAST(prod_callers AS STRING) || ' production / ' || CAST(test_callers AS STRING) || ' test' AS split FROM ({IMPORTANCE_SQL})")
def d10(spark, d):
    return importance(facts(spark, d)).select("id", F.format_string("%d production / %d test", "prod_callers", "test_callers").alias("split"))


@query("w12_rank", graph=f"SELECT id, score FROM ({IMPORTANCE_SQL}) ORDER BY score DESC, name, id LIMIT 20")
def w12(spark, d):
    return importance(facts(spark, d)).orderBy(F.desc("score"), "name", "id").limit(20).select("id", "score")


@query(
    "d17_core_types",
    graph=f"SELECT i.id, i.score FROM ({IMPORTANCE_SQL}) i JOIN nodes n ON n.id = i.id WHERE n.kind = 'Type' AND NOT {TEST_SQL.replace('file', 'n.file').replace('name', 'n.name')} ORDER BY i.score DESC, i.name, i.id LIMIT 15",
)
def d17(spark, d):
    rows = importance(facts(spark, d)).where("kind = 'Type'").where(~is_test())
    return rows.orderBy(F.desc("score"), "name", "id").limit(15).select("id", "score")


@query(
    "d12_overview",
    graph="""SELECT s.file AS src_file, t.file AS dst_file, e.kind, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes t ON t.id = e.dst
             WHERE s.file <> t.file AND e.kind IN ('CALLS', 'IMPORTS', 'EXPOSES', 'CONTAINS') GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 60""",
)
def d12(spark, d):
    g = facts(spark, d)
    end = lambda k: g.nodes.select(F.col("id").alias(k), F.col("file").alias(f"{k}_file")).where(f"{k}_file IS NOT NULL")
    rows = N.edges_of_kind(g, "CALLS", "IMPORTS", "EXPOSES", "CONTAINS").select("src", "dst", "kind").join(end("src"), "src").join(end("dst"), "dst")
    counted = rows.where("src_file <> dst_file").groupBy("src_file", "dst_file", "kind").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "src_file", "dst_file", "kind").limit(60)


@query(
    "d12b_files_by_kind",
    graph="SELECT file, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k.lower()}s" for k in ("Module", "Type", "Function")) + " FROM nodes WHERE file IS NOT NULL GROUP BY file",
)
def d12b(spark, d):
    agg = [F.count_if(F.col("kind") == k).alias(f"{k.lower()}s") for k in ("Module", "Type", "Function")]
    return nodes_(spark, d).where("file IS NOT NULL").groupBy("file").agg(*agg)


@query(
    "d12c_degree",
    graph="SELECT n.id, count(x.id) AS degree FROM nodes n LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) x ON x.id = n.id WHERE n.kind IN ('Module', 'Type', 'Function') GROUP BY n.id",
)
def d12c(spark, d):
    g = facts(spark, d)
    degree = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return g.nodes.where("kind IN ('Module', 'Type', 'Function')").select("id").join(degree, "id", "left").fillna(0, ["degree"])


@query("d14_api_split", graph=f"SELECT ({PUBLIC_SQL}) AS public, count(*) AS n, count(DISTINCT language) AS languages FROM nodes WHERE kind IN ('Type', 'Function') GROUP BY 1")
def d14(spark, d):
    rows = nodes_(spark, d).where("kind IN ('Type', 'Function')")
    return rows.groupBy(is_public().alias("public")).agg(F.count("*").alias("n"), F.count_distinct("language").alias("languages"))


STYLES = {"snake_case": "^[a-z0-9_]+$", "PascalCase": "^[A-Z][A-Za-z0-9]*$", "camelCase": "^[a-z]+[A-Z][A-Za-z0-9]*$"}


@query(
    "d15_naming_styles",
    graph="SELECT kind, " + ", ".join(f"count(*) FILTER (regexp_matches(name, '{r}')) AS \"{s}\"" for s, r in STYLES.items()) + " FROM nodes WHERE kind IN ('Type', 'Function') GROUP BY kind",
)
def d15(spark, d):
    rows = nodes_(spark, d).where("kind IN ('Type', 'Function')")
    return rows.groupBy("kind").agg(*[F.count_if(F.rlike("name", F.lit(r))).alias(s) for s, r in STYLES.items()])


@query(
    "d16_test_layout",
    graph=f"SELECT regexp_replace(file, '/[^/]*$', '') AS directory, count(DISTINCT file) AS files FROM nodes WHERE {TEST_SQL} AND file IS NOT NULL GROUP BY 1 ORDER BY files DESC, directory LIMIT 4",
)
def d16(spark, d):
    rows = nodes_(spark, d).where(is_test()).where("file IS NOT NULL")
    by = rows.groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("directory")).agg(F.count_distinct("file").alias("files"))
    return by.orderBy(F.desc("files"), "directory").limit(4)


# --- state report, metric by metric


@query(
    "d11a_kind_counts",
    graph="SELECT k.kind, count(n.id) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind" for k in NODE_KINDS) + ") k LEFT JOIN nodes n ON n.kind = k.kind AND NOT n.external GROUP BY k.kind",
)
def d11a(spark, d):
    counted = nodes_(spark, d).where("NOT external").groupBy("kind").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(k,) for k in NODE_KINDS], "kind string").join(counted, "kind", "left").fillna(0, ["n"])


MEMBERS = "SELECT t.id, t.name, t.file, count(e.dst) AS members FROM nodes t LEFT JOIN edges e ON e.src = t.id AND e.kind = 'CONTAINS' WHERE t.kind = 'Type' GROUP BY 1, 2, 3"


def members(g):
    n = N.edges_of_kind(g, "CONTAINS").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("members"))
    return g.nodes.where("kind = 'Type'").select("id", "name", "file").join(n, "id", "left").fillna(0, ["members"])


@query("d11b_members", graph=f"SELECT id, members FROM ({MEMBERS}) WHERE members > 0")
def d11b(spark, d):
    return members(facts(spark, d)).where("members > 0").select("id", "members")


@query("d11c_layers", graph=f"SELECT {LAYER_SQL} AS layer, count(*) AS n FROM nodes WHERE kind = 'Type' AND coalesce(NOT regexp_matches(file, '{GENERATED}'), true) GROUP BY 1")
def d11c(spark, d):
    rows = nodes_(spark, d).where("kind = 'Type'").where(F.coalesce(~F.rlike("file", F.lit(GENERATED)), F.lit(True)))
    return rows.groupBy(layer().alias("layer")).agg(F.count("*").alias("n"))


AREA_SQL = "CASE WHEN contains({0}, '/') THEN array_to_string(string_split({0}, '/')[1:2], '/') ELSE array_to_string(string_split({0}, '.')[1:2], '.') END"


@query(
    "d11d_types_per_area",
    graph=f"SELECT {AREA_SQL.format('m.name')} AS area, count(*) AS n FROM edges e JOIN nodes m ON m.id = e.src JOIN nodes t ON t.id = e.dst WHERE e.kind = 'CONTAINS' AND m.kind = 'Module' AND t.kind = 'Type' GROUP BY 1",
)
def d11d(spark, d):
    g = facts(spark, d)
    types = g.nodes.where("kind = 'Type'").select(F.col("id").alias("dst"))
    mods = g.nodes.where("kind = 'Module'").select(F.col("id").alias("src"), "name")
    rows = N.edges_of_kind(g, "CONTAINS").join(types, "dst", "left_semi").join(mods, "src")
    return rows.groupBy(H.area_of_name(F.col("name")).alias("area")).agg(F.count("*").alias("n"))


OWNER_SQL = """, up AS (SELECT dst AS child, arg_max(src, seq) AS parent FROM edges WHERE kind = 'CONTAINS' GROUP BY dst),
    walk AS (SELECT id, id AS at, 0 AS hop FROM nodes
             UNION ALL SELECT w.id, u.parent, w.hop + 1 FROM walk w JOIN up u ON u.child = w.at
             WHERE w.hop < 4 AND (w.hop = 0 OR w.at NOT IN (SELECT id FROM nodes WHERE kind = 'Module'))),
    owner AS (SELECT w.id, w.at AS module FROM walk w JOIN nodes m ON m.id = w.at AND m.kind = 'Module' WHERE w.hop > 0)"""


@query("h07_owning_module", graph=OWNER_SQL + " SELECT id, module FROM owner")
def h07(spark, d):
    return H.owning_modules(facts(spark, d))


@query("h08_module_of", graph=OWNER_SQL + " SELECT id, module FROM owner WHERE id NOT IN (SELECT id FROM nodes WHERE kind = 'Module') UNION ALL SELECT id, id FROM nodes WHERE kind = 'Module'")
def h08(spark, d):
    return H.owning_modules(facts(spark, d), include_self=True)


@query(
    "h09_area_of",
    graph=OWNER_SQL
    + f" SELECT n.id, coalesce({AREA_SQL.format('m.name')}, {AREA_SQL.format('n.file')}, list_extract(string_split(n.id, ':'), -1)) AS area FROM nodes n LEFT JOIN owner o ON o.id = n.id LEFT JOIN nodes m ON m.id = o.module WHERE n.kind IN ('Type', 'Function', 'Doc')",
)
def h09(spark, d):
    g = facts(spark, d)
    named = H.owning_modules(g).join(g.nodes.select(F.col("id").alias("module"), F.col("name").alias("module_name")), "module")
    rows = g.nodes.where("kind IN ('Type', 'Function', 'Doc')").select("id", "file").join(named, "id", "left")
    return rows.select("id", F.coalesce(H.area_of_name(F.col("module_name")), H.area_of_name(F.col("file")), F.substring_index("id", ":", -1)).alias("area"))


@query("h10_module_first_parent", graph=OWNER_SQL.replace("arg_max", "arg_min") + " SELECT id, module FROM owner WHERE id NOT IN (SELECT id FROM nodes WHERE kind = 'Module') UNION ALL SELECT id, id FROM nodes WHERE kind = 'Module'")
def h10(spark, d):
    return H.owning_modules(facts(spark, d), first=True, include_self=True)


@query("h11_module_or_file", graph=OWNER_SQL + " SELECT n.id, coalesce(o.module, n.file, '') AS owner FROM nodes n LEFT JOIN owner o ON o.id = n.id WHERE n.kind IN ('Type', 'Function', 'Entity')")
def h11(spark, d):
    g = facts(spark, d)
    rows = g.nodes.where("kind IN ('Type', 'Function', 'Entity')").select("id", "file").join(H.owning_modules(g), "id", "left")
    return rows.select("id", F.coalesce("module", "file", F.lit("")).alias("owner"))


@query("h12_file_of", graph="SELECT id, file FROM nodes WHERE kind = 'Function'")
def h12(spark, d):
    return nodes_(spark, d).where("kind = 'Function'").select("id", "file")


@query("d11e_functions_per_area", graph=OWNER_SQL + f" SELECT {AREA_SQL.format('m.name')} AS area, count(*) AS n FROM nodes f JOIN owner o ON o.id = f.id JOIN nodes m ON m.id = o.module WHERE f.kind = 'Function' GROUP BY 1")
def d11e(spark, d):
    g = facts(spark, d)
    named = H.owning_modules(g).join(g.nodes.select(F.col("id").alias("module"), "name"), "module")
    rows = g.nodes.where("kind = 'Function'").select("id").join(named, "id")
    return rows.groupBy(H.area_of_name(F.col("name")).alias("area")).agg(F.count("*").alias("n"))


@query("d11f_controllers", graph=f"SELECT name, members FROM ({MEMBERS}) WHERE name LIKE '%Service' ORDER BY members DESC, name, id LIMIT 8")
def d11f(spark, d):
    return members(facts(spark, d)).where(F.col("name").endswith("Service")).orderBy(F.desc("members"), "name", "id").limit(8).select("name", "members")


COUPLING = """SELECT s.name AS src_area, t.name AS dst_area, count(*) AS weight FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes t ON t.id = e.dst
    WHERE e.kind = 'IMPORTS' AND s.name <> t.name GROUP BY 1, 2"""


def coupling(g):
    name = lambda k, as_: g.nodes.where("kind = 'Module'").select(F.col("id").alias(k), F.col("name").alias(as_))
    rows = N.edges_of_kind(g, "IMPORTS").join(name("src", "src_area"), "src").join(name("dst", "dst_area"), "dst").where("src_area <> dst_area")
    return rows.groupBy("src_area", "dst_area").agg(F.count("*").alias("weight"))


@query("d11g_coupling", graph=COUPLING)
def d11g(spark, d):
    return coupling(facts(spark, d))


@query("d11g2_external_dependencies", graph="SELECT t.name, count(*) AS n FROM edges e JOIN nodes t ON t.id = e.dst WHERE e.kind = 'IMPORTS' AND t.external GROUP BY 1")
def d11g2(spark, d):
    g = facts(spark, d)
    return N.edges_of_kind(g, "IMPORTS").join(g.nodes.where("external").select(F.col("id").alias("dst"), "name"), "dst").groupBy("name").agg(F.count("*").alias("n"))


@query("d11h_interface_count", graph="SELECT count(*) AS interfaces FROM nodes WHERE kind = 'Type' AND regexp_matches(name, '^I[A-Z]')")
def d11h(spark, d):
    return nodes_(spark, d).where("kind = 'Type'").agg(F.count_if(F.rlike("name", F.lit("^I[A-Z]"))).alias("interfaces"))


@query("d11i_biggest_types", graph=f"SELECT name, members FROM ({MEMBERS}) WHERE coalesce(NOT regexp_matches(file, '{GENERATED}'), true) ORDER BY members DESC, name, id LIMIT 10")
def d11i(spark, d):
    rows = members(facts(spark, d)).where(F.coalesce(~F.rlike("file", F.lit(GENERATED)), F.lit(True)))
    return rows.orderBy(F.desc("members"), "name", "id").limit(10).select("name", "members")


@query("d11j_size_buckets", graph=f"SELECT CASE WHEN members > 40 THEN 'god' WHEN members > 25 THEN '>25' WHEN members > 10 THEN '>10' WHEN members > 0 THEN '1-10' ELSE 'marker' END AS bucket, count(*) AS n FROM ({MEMBERS}) GROUP BY 1")
def d11j(spark, d):
    m = F.col("members")
    bucket = F.when(m > 40, "god").when(m > 25, ">25").when(m > 10, ">10").when(m > 0, "1-10").otherwise("marker")
    return members(facts(spark, d)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("d11k_untested_areas", graph=f"SELECT DISTINCT dst_area AS area FROM ({COUPLING}) WHERE dst_area NOT IN (SELECT dst_area FROM ({COUPLING}) WHERE src_area LIKE 'asia%')")
def d11k(spark, d):
    c = coupling(facts(spark, d))
    tested = c.where(F.col("src_area").startswith("asia")).select("dst_area")
    return c.select("dst_area").distinct().join(tested, "dst_area", "left_anti").select(F.col("dst_area").alias("area"))


@query("d11l_duplicate_types", graph="SELECT name, count(*) AS n FROM nodes WHERE kind = 'Type' GROUP BY name HAVING count(*) > 1 ORDER BY n DESC, name LIMIT 10")
def d11l(spark, d):
    n = nodes_(spark, d).where("kind = 'Type'").groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    return n.orderBy(F.desc("n"), "name").limit(10)


@query("d11m_data_access", graph="SELECT bool_or(name LIKE '%Repository') AS repositories, bool_or(kind = 'Entity') AS entities, bool_or(file LIKE '%.sql') AS sql_files FROM nodes")
def d11m(spark, d):
    return nodes_(spark, d).agg(
        F.bool_or(F.col("name").endswith("Repository")).alias("repositories"), F.bool_or(F.col("kind") == "Entity").alias("entities"), F.bool_or(F.col("file").endswith(".sql")).alias("sql_files")
    )


@query("d11n_most_called", graph="SELECT e.dst AS id, count(*) AS calls FROM edges e WHERE e.kind = 'CALLS' AND e.dst IN (SELECT id FROM nodes WHERE kind = 'Function') GROUP BY 1 ORDER BY calls DESC, id LIMIT 10")
def d11n(spark, d):
    g = facts(spark, d)
    n = N.edges_of_kind(g, "CALLS").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls"))
    return n.join(g.nodes.where("kind = 'Function'").select("id"), "id", "left_semi").orderBy(F.desc("calls"), "id").limit(10)


@query("d11o_any_calls", graph="SELECT count(*) > 0 AS any_calls FROM edges WHERE kind = 'CALLS'")
def d11o(spark, d):
    return N.edges_of_kind(facts(spark, d), "CALLS").limit(1).agg((F.count("*") > 0).alias("any_calls"))


@query("d11p_auth_surface", graph="SELECT id FROM nodes WHERE kind = 'Type' AND regexp_matches(lower(name), 'auth|login|customer1[0-9]+controller') ORDER BY seq LIMIT 12")
def d11p(spark, d):
    return nodes_(spark, d).where("kind = 'Type'").where(F.rlike(F.lower("name"), F.lit("auth|login|customer1[0-9]+controller"))).orderBy("seq").limit(12).select("id")


@query(
    "d11q_doc_coverage",
    graph="SELECT count(*) AS coverable, count(*) FILTER (id IN (SELECT dst FROM edges WHERE kind = 'MENTIONS')) AS documented FROM nodes WHERE kind IN ('Type', 'Function') AND NOT external",
)
def d11q(spark, d):
    g = facts(spark, d)
    coverable = g.nodes.where("kind IN ('Type', 'Function') AND NOT external").select("id")
    mentioned = N.edges_of_kind(g, "MENTIONS").select(F.col("dst").alias("id"), F.lit(1).alias("m")).distinct()
    return coverable.join(mentioned, "id", "left").agg(F.count("*").alias("coverable"), F.count("m").alias("documented"))


@query("d11s_entry_points", graph=f"SELECT id FROM nodes WHERE kind = 'Function' AND NOT {TEST_SQL} AND regexp_matches(name, '(^|_)red_') ORDER BY id LIMIT 8")
def d11s(spark, d):
    return nodes_(spark, d).where("kind = 'Function'").where(~is_test() & F.rlike("name", F.lit("(^|_)red_"))).orderBy("id").limit(8).select("id")


@query("d13_area_rollup", graph=f"SELECT src_area AS area, count(DISTINCT dst_area) AS imports, sum(weight)::BIGINT AS weight FROM ({COUPLING}) GROUP BY 1")
def d13(spark, d):
    return coupling(facts(spark, d)).groupBy(F.col("src_area").alias("area")).agg(F.count_distinct("dst_area").alias("imports"), F.sum("weight").alias("weight"))


# --- rankings


@query("w13_module_pages", graph="SELECT m.id, count(*) AS children FROM nodes m JOIN edges e ON e.src = m.id AND e.kind = 'CONTAINS' JOIN nodes c ON c.id = e.dst AND c.kind IN ('Type', 'Function') WHERE m.kind = 'Module' GROUP BY 1 ORDER BY children DESC, id LIMIT 12")
def w13(spark, d):
    g = facts(spark, d)
    kids = g.nodes.where("kind IN ('Type', 'Function')").select(F.col("id").alias("dst"))
    n = N.edges_of_kind(g, "CONTAINS").join(kids, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("children"))
    return n.join(g.nodes.where("kind = 'Module'").select("id"), "id", "left_semi").orderBy(F.desc("children"), "id").limit(12)


@query("w14_entity_pages", graph="SELECT n.id, count(*) AS degree FROM (SELECT src AS id FROM edges WHERE kind = 'REFERENCES' UNION ALL SELECT dst FROM edges WHERE kind = 'REFERENCES') x JOIN nodes n ON n.id = x.id AND n.kind = 'Entity' GROUP BY 1 ORDER BY degree DESC, id LIMIT 12")
def w14(spark, d):
    g = facts(spark, d)
    degree = N.edges_of_kind(g, "REFERENCES").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return degree.join(g.nodes.where("kind = 'Entity'").select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(12)


@query("w15_area_pages", graph=f"SELECT src_area AS area, sum(weight)::BIGINT AS size FROM ({COUPLING}) GROUP BY 1 ORDER BY size DESC, area LIMIT 5")
def w15(spark, d):
    return coupling(facts(spark, d)).groupBy(F.col("src_area").alias("area")).agg(F.sum("weight").alias("size")).orderBy(F.desc("size"), "area").limit(5)


@query(
    "w16_onboarding_path",
    graph="""SELECT id FROM (SELECT id, min(rank) AS rank FROM (
        SELECT id, -1 AS rank FROM nodes WHERE kind = 'Module' AND name = 'asia'
        UNION ALL SELECT id, row_number() OVER (ORDER BY n DESC, id) FROM (SELECT dst AS id, count(DISTINCT src) AS n FROM edges WHERE kind = 'IMPORTS' AND src <> dst GROUP BY dst)) GROUP BY id) ORDER BY rank LIMIT 5""",
)
def w16(spark, d):
    g = facts(spark, d)
    entry = g.nodes.where("kind = 'Module' AND name = 'asia'").select("id", F.lit(None).cast("long").alias("n"))
    importers = N.edges_of_kind(g, "IMPORTS").where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    both = entry.unionByName(importers).groupBy("id").agg(F.bool_or(F.col("n").isNull()).alias("entry"), F.max("n").alias("n"))
    return both.orderBy(F.desc("entry"), F.desc("n"), "id").limit(5).select("id")


@query(
    "w17_hotspots",
    graph="""SELECT n.id, coalesce(c.n, 0) AS callers, coalesce(x.n, 0) AS exposed FROM nodes n
        LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE kind = 'CALLS' GROUP BY dst) c ON c.dst = n.id
        LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE kind = 'EXPOSES' GROUP BY dst) x ON x.dst = n.id
        WHERE n.kind = 'Function' AND coalesce(c.n, 0) + coalesce(x.n, 0) > 0 ORDER BY callers + exposed DESC, exposed DESC, n.name, n.id LIMIT 10""",
)
def w17(spark, d):
    g = facts(spark, d)
    kinds = N.edges_of_kind(g, "CALLS", "EXPOSES").groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("kind") == "CALLS").alias("callers"), F.count_if(F.col("kind") == "EXPOSES").alias("exposed"))
    rows = kinds.join(g.nodes.where("kind = 'Function'").select("id", "name"), "id")
    return rows.orderBy(F.desc(F.col("callers") + F.col("exposed")), F.desc("exposed"), "name", "id").limit(10).select("id", "callers", "exposed")


@query(
    "w18_architecture_edges",
    graph=f"""SELECT src_area, dst_area, weight FROM (SELECT * FROM ({COUPLING}) ORDER BY weight DESC, src_area, dst_area LIMIT 40)
              WHERE src_area NOT LIKE 'africa%' ORDER BY weight DESC, src_area, dst_area LIMIT 14""",
)
def w18(spark, d):
    order = [F.desc("weight"), "src_area", "dst_area"]
    top = coupling(facts(spark, d)).orderBy(*order).limit(40)
    return top.where(~F.col("src_area").startswith("africa")).orderBy(*order).limit(14)


@query("w07_sample_edges", graph="SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY src, dst, seq) - 1 AS rn, count(*) OVER () AS n FROM edges WHERE kind = 'IMPLEMENTS') WHERE rn % greatest(1, n // 20) = 0 ORDER BY rn LIMIT 20")
def w07(spark, d):
    rows = N.edges_of_kind(facts(spark, d), "IMPLEMENTS").select("src", "dst", "seq")
    n = rows.count()
    # every k-th of the sorted rows
    ranked = T.positions(rows, "src", "dst", "seq")
    return ranked.where(F.col("position") % max(1, n // 20) == 0).orderBy("position").limit(20).select("src", "dst")


# --- set operations and hierarchy rollups


@query("u01_known_dirs", graph="SELECT DISTINCT array_to_string(p[1:k], '/') AS dir FROM (SELECT string_split(file, '/') AS p, unnest(range(1, len(string_split(file, '/')))) AS k FROM (SELECT DISTINCT file FROM nodes WHERE file IS NOT NULL))")
def u01(spark, d):
    parts = nodes_(spark, d).where("file IS NOT NULL").select("file").distinct().select(F.split("file", "/").alias("p")).where("size(p) > 1")
    dirs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))
    return parts.select(F.explode(dirs).alias("dir")).distinct()


@query("u05_landing_files", graph="SELECT file FROM (SELECT file, min(seq) AS s FROM edges WHERE kind = 'EXPOSES' OR kind = 'READS' GROUP BY file) ORDER BY s, file LIMIT 8")
def u05(spark, d):
    return N.edges_of_kind(facts(spark, d), "EXPOSES", "READS").groupBy("file").agg(F.min("seq").alias("s")).orderBy("s", "file").limit(8).select("file")


@query("u06_multiset_difference", graph="SELECT * FROM (SELECT src, kind FROM edges WHERE kind IN ('READS', 'WRITES') EXCEPT ALL SELECT src, 'READS' FROM edges WHERE kind = 'WRITES')")
def u06(spark, d):
    g = facts(spark, d)
    return N.edges_of_kind(g, "READS", "WRITES").select("src", "kind").exceptAll(N.edges_of_kind(g, "WRITES").select("src", F.lit("READS").alias("kind")))


@query("u07_design_disagreement", graph="SELECT 'planned' AS side, id FROM (SELECT dst AS id FROM edges WHERE kind = 'READS' EXCEPT SELECT dst FROM edges WHERE kind = 'WRITES') UNION ALL SELECT 'touched', id FROM (SELECT dst AS id FROM edges WHERE kind = 'WRITES' EXCEPT SELECT dst FROM edges WHERE kind = 'READS')")
def u07(spark, d):
    sides = N.edges_of_kind(facts(spark, d), "READS", "WRITES").groupBy(F.col("dst").alias("id")).agg(F.bool_or(F.col("kind") == "READS").alias("r"), F.bool_or(F.col("kind") == "WRITES").alias("w"))
    return sides.where("r <> w").select(F.when(F.col("r"), "planned").otherwise("touched").alias("side"), "id")


@query("j58_readers_writers", lists=("readers", "writers",), graph="SELECT dst AS entity, list_sort(list(DISTINCT src) FILTER (kind = 'READS')) AS readers, list_sort(list(DISTINCT src) FILTER (kind = 'WRITES')) AS writers FROM edges WHERE kind IN ('READS', 'WRITES') GROUP BY 1".replace("list_sort(list", "coalesce(list_sort(list").replace("'READS'))", "'READS')), [])").replace("'WRITES'))", "'WRITES')), [])"))
def j58(spark, d):
    side = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("src"))))
    return N.edges_of_kind(facts(spark, d), "READS", "WRITES").groupBy(F.col("dst").alias("entity")).agg(side("READS").alias("readers"), side("WRITES").alias("writers"))


@query("j59_module_deps", graph=OWNER_SQL + " SELECT DISTINCT a.module AS src, b.module AS dst FROM edges e JOIN owner a ON a.id = e.src JOIN owner b ON b.id = e.dst WHERE e.kind IN ('IMPLEMENTS', 'CALLS') AND a.module <> b.module")
def j59(spark, d):
    g = facts(spark, d)
    own = H.owning_modules(g)
    side = lambda k: own.select(F.col("id").alias(k), F.col("module").alias(f"{k}_module"))
    # distinct pairs first: the join is on pairs, not on call sites
    pairs = N.edges_of_kind(g, "IMPLEMENTS", "CALLS").select("src", "dst").distinct()
    rows = pairs.join(side("src"), "src").join(side("dst"), "dst").where("src_module <> dst_module")
    return rows.select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")).distinct()


@query("j61_symbol_index", graph=OWNER_SQL + " SELECT n.name, n.id, o.module FROM nodes n LEFT JOIN owner o ON o.id = n.id WHERE n.kind = 'Type' ORDER BY lower(n.name), n.id")
def j61(spark, d):
    g = facts(spark, d)
    rows = g.nodes.where("kind = 'Type'").select("name", "id").join(H.owning_modules(g), "id", "left")
    return rows.select("name", "id", "module").orderBy(F.lower("name"), "id")


@query("j57_symbols_by_name", graph="SELECT id FROM nodes WHERE name IN ('Customer12Controller', 'nation_3') OR list_extract(string_split(name, '.'), -1) IN ('Customer12Controller', 'nation_3') ORDER BY id LIMIT 20")
def j57(spark, d):
    wanted = ["Customer12Controller", "nation_3"]
    return nodes_(spark, d).where(F.col("name").isin(wanted) | F.substring_index("name", ".", -1).isin(wanted)).orderBy("id").limit(20).select("id")


# --- walks

IMPACT_KINDS = ("CALLS", "EXPOSES", "CONSUMES")
WALK = """, hops AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE kind IN ({kinds}) {extra}),
    walk AS (SELECT id AS start, id AS node, 0 AS hop FROM ({starts})
             UNION SELECT w.start, h.b, w.hop + 1 FROM walk w JOIN hops h ON h.a = w.node WHERE w.hop < {depth})"""


def walk_sql(starts, kinds, depth, reverse=True, known=False):
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return WALK.format(a=a, b=b, kinds=", ".join(f"'{k}'" for k in kinds), extra=f"AND {b} IN (SELECT id FROM nodes)" if known else "", starts=starts, depth=depth)


def hops(g, *kinds, reverse=True):
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return N.edges_of_kind(g, *kinds).select(F.col(a).alias("a"), F.col(b).alias("b"))


STARTS = "SELECT 'part:7' AS id UNION ALL SELECT 'part:150' UNION ALL SELECT 'endpoint:view'"


def starts(spark):
    return spark.createDataFrame([("part:7",), ("part:150",), ("endpoint:view",)], "id string")


@query("g01_impact_of", graph=walk_sql(STARTS, IMPACT_KINDS, 4, known=True) + " SELECT start, node, min(hop) AS hop FROM walk WHERE node <> start GROUP BY 1, 2")
def g01(spark, d):
    g = facts(spark, d)
    return T.reach(starts(spark), hops(g, *IMPACT_KINDS), 4, g.nodes)


ACROSS = ("CALLS", "IMPORTS", "REFERENCES", "EXPOSES", "CONSUMES")


@query("g02_impact_across", graph=walk_sql("SELECT 'customer:7' AS id UNION ALL SELECT 'order:3' UNION ALL SELECT 'nation:2'", ACROSS, 3, known=True) + " SELECT start, node, min(hop) AS hop FROM walk WHERE node <> start GROUP BY 1, 2")
def g02(spark, d):
    g = facts(spark, d)
    return T.reach(spark.createDataFrame([("customer:7",), ("order:3",), ("nation:2",)], "id string"), hops(g, *ACROSS), 3, g.nodes)


TESTS = f"SELECT id FROM nodes WHERE kind = 'Function' AND {TEST_SQL}"


def from_tests(g):
    """Distinct functions that tests reach: one shared walk, not one a test."""
    tests = g.nodes.where("kind = 'Function'").where(is_test()).select("id")
    entry = hops(g, "CALLS", reverse=False).join(tests, F.col("a") == F.col("id"), "left_semi").select("b").distinct()
    one = F.lit("*")
    joined = hops(g, "CALLS", reverse=False).unionByName(entry.select(one.alias("a"), "b"))
    root = g.nodes.sparkSession.createDataFrame([("*",)], "id string")
    return tests, T.reach(root, joined).select(F.col("node").alias("id"))


REACHED = f""", hops AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE kind = 'CALLS'),
    reached AS (SELECT b AS id FROM hops WHERE a IN ({TESTS}) UNION SELECT h.b FROM reached r JOIN hops h ON h.a = r.id)"""


@query("g03_reached_from_tests", graph=REACHED + " SELECT id FROM reached")
def g03(spark, d):
    return from_tests(facts(spark, d))[1]


@query("g04_untested_blast_radius", graph=walk_sql("SELECT 'part:7' AS id", ("CALLS",), 4) + f" SELECT DISTINCT w.node FROM walk w JOIN nodes n ON n.id = w.node WHERE w.node <> 'part:7' AND NOT {TEST_SQL.replace('file', 'n.file').replace('name', 'n.name')}")
def g04(spark, d):
    g = facts(spark, d)
    found = T.reach(spark.createDataFrame([("part:7",)], "id string"), hops(g, "CALLS"), 4)
    return found.join(g.nodes.where(~is_test()).select(F.col("id").alias("node")), "node", "left_semi").select("node")


@query("g05_regression_plan", graph=walk_sql("SELECT 'part:9' AS id", ("CALLS",), 2, known=True) + REACHED.replace(", hops", ", hops2").replace("FROM hops WHERE", "FROM hops2 WHERE").replace("JOIN hops h", "JOIN hops2 h") + " SELECT w.node, w.node IN (SELECT id FROM reached) AS covered FROM (SELECT DISTINCT node FROM walk WHERE node <> 'part:9') w")
def g05(spark, d):
    g = facts(spark, d)
    impacted = T.reach(spark.createDataFrame([("part:9",)], "id string"), hops(g, "CALLS"), 2, g.nodes).select("node")
    covered = from_tests(g)[1].select(F.col("id").alias("node"), F.lit(True).alias("covered"))
    return impacted.join(covered, "node", "left").fillna(False, ["covered"])


@query("g06_reached_by_test", graph=walk_sql("SELECT id FROM nodes WHERE id IN ('part:3', 'part:8', 'part:190')", ("CALLS",), 3) + f" SELECT start, bool_or(node IN ({TESTS}) AND node <> start) AS reached FROM walk GROUP BY start")
def g06(spark, d):
    g = facts(spark, d)
    some = g.nodes.where("id IN ('part:3', 'part:8', 'part:190')").select("id")
    tests = g.nodes.where("kind = 'Function'").where(is_test()).select(F.col("id").alias("node"))
    hit = T.reach(some, hops(g, "CALLS"), 3).join(tests, "node", "left_semi").select(F.col("start").alias("id"), F.lit(True).alias("reached")).distinct()
    return some.join(hit, "id", "left").select(F.col("id").alias("start"), F.coalesce("reached", F.lit(False)).alias("reached"))


IMPORT_HOPS = "hops AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE kind = 'IMPORTS' AND src <> dst)"


@query(
    "g07_import_cycles",
    graph=f""", {IMPORT_HOPS}, r AS (SELECT a AS s, b AS t FROM hops UNION SELECT r.s, h.b FROM r JOIN hops h ON h.a = r.t)
        SELECT x.s AS node, least(x.s, min(x.t)) AS component FROM r x JOIN r y ON y.s = x.t AND y.t = x.s WHERE x.s <> x.t GROUP BY x.s""",
)
def g07(spark, d):
    return T.strong_components(hops(facts(spark, d), "IMPORTS", reverse=False))


UNDIRECTED = f"SELECT a, b, sum(weight)::BIGINT AS weight FROM (SELECT src_area AS a, dst_area AS b, weight FROM ({COUPLING}) UNION ALL SELECT dst_area, src_area, weight FROM ({COUPLING})) WHERE a <> b GROUP BY 1, 2"


def undirected(c):
    both = c.select(F.col("src_area").alias("a"), F.col("dst_area").alias("b"), "weight").union(c.select("dst_area", "src_area", "weight"))
    return both.where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


@query("g11_undirected", graph=UNDIRECTED)
def g11(spark, d):
    return undirected(coupling(facts(spark, d)))


@query("g10_significant_edges", graph=f"SELECT src_area, dst_area, weight FROM ({COUPLING}) WHERE weight >= (SELECT avg(weight) FROM ({COUPLING}))")
def g10(spark, d):
    c = coupling(facts(spark, d))
    return c.join(F.broadcast(c.agg(F.avg("weight").alias("mean"))), F.col("weight") >= F.col("mean")).select("src_area", "dst_area", "weight")


@query(
    "g09_modularity",
    graph=f""", u AS ({UNDIRECTED}), k AS (SELECT a, sum(weight) AS k FROM u GROUP BY a), m AS (SELECT sum(weight) AS m2 FROM u)
        SELECT round(coalesce((SELECT sum(weight) FROM u WHERE string_split(a, '.')[1] = string_split(b, '.')[1]) / m2, 0)
               - (SELECT sum(s * s) FROM (SELECT sum(k) AS s FROM k GROUP BY string_split(a, '.')[1])) / (m2 * m2), 9) AS q FROM m""",
)
def g09(spark, d):
    u = undirected(coupling(facts(spark, d)))
    group = lambda c: F.substring_index(c, ".", 1)
    total = u.agg(F.sum("weight").alias("m2"), F.sum(F.when(group("a") == group("b"), F.col("weight")).otherwise(0)).alias("inside"))
    squares = u.groupBy(group("a").alias("g")).agg(F.sum("weight").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return total.join(F.broadcast(squares)).select(F.round(F.col("inside") / F.col("m2") - F.col("ss") / (F.col("m2") * F.col("m2")), 9).alias("q"))


@query("g08_communities")
def g08(spark, d):
    return label_propagation(undirected(coupling(facts(spark, d))))


@query("g12_architecture_clusters")
def g12(spark, d):
    c = coupling(facts(spark, d)).where(~F.col("src_area").startswith("africa") & ~F.col("dst_area").startswith("africa"))
    kept = c.join(F.broadcast(c.agg(F.avg("weight").alias("mean"))), F.col("weight") >= F.col("mean")).select("src_area", "dst_area", "weight")
    return label_propagation(undirected(kept))


@query("g13_error_subtypes", graph=""", walk AS (SELECT id FROM nodes WHERE kind = 'Type' AND regexp_matches(name, '(Error|Exception)$') AND id IN (SELECT dst FROM edges WHERE kind = 'IMPLEMENTS')
    UNION SELECT e.src FROM walk w JOIN edges e ON e.dst = w.id AND e.kind = 'IMPLEMENTS') SELECT id FROM walk""")
def g13(spark, d):
    g = facts(spark, d)
    bases = g.nodes.where("kind = 'Type'").where(F.rlike("name", F.lit("(Error|Exception)$"))).select("id")
    bases = bases.join(N.edges_of_kind(g, "IMPLEMENTS").select(F.col("dst").alias("id")), "id", "left_semi")
    root = spark.createDataFrame([("*",)], "id string")
    down = hops(g, "IMPLEMENTS").unionByName(bases.select(F.lit("*").alias("a"), F.col("id").alias("b")))
    return T.reach(root, down).select(F.col("node").alias("id"))


@query("g14_dag_check", graph=f""", {IMPORT_HOPS}, r AS (SELECT a AS s, b AS t FROM hops UNION SELECT r.s, h.b FROM r JOIN hops h ON h.a = r.t),
    cyc AS (SELECT DISTINCT s FROM r WHERE s = t) SELECT DISTINCT id FROM (SELECT s AS id FROM cyc UNION SELECT t FROM r WHERE s IN (SELECT s FROM cyc))""")
def g14(spark, d):
    return T.acyclic_leftover(hops(facts(spark, d), "IMPORTS", reverse=False).where("a <> b"))


@query("g15_unreachable", graph=""", hops AS (SELECT src AS a, dst AS b FROM edges WHERE kind = 'IMPLEMENTS'), entry AS (SELECT DISTINCT b AS id FROM hops WHERE b NOT IN (SELECT a FROM hops)),
    r AS (SELECT id FROM entry UNION SELECT h.a FROM r JOIN hops h ON h.b = r.id) SELECT DISTINCT a AS id FROM hops WHERE a NOT IN (SELECT id FROM r)""")
def g15(spark, d):
    up = hops(facts(spark, d), "IMPLEMENTS")  # a base and what implements it
    entry = up.select(F.col("a").alias("id")).distinct().join(up.select(F.col("b").alias("id")), "id", "left_anti")
    all_hops = up.unionByName(entry.select(F.lit("*").alias("a"), F.col("id").alias("b")))
    seen = T.reach(spark.createDataFrame([("*",)], "id string"), all_hops).select(F.col("node").alias("id"))
    return up.select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")


@query("g17_linear_chain", graph="SELECT count(*) FILTER (i = 0) AS heads, count(*) FILTER (o = 0) AS tails, max(i) AS max_in, max(o) AS max_out FROM (SELECT id, count(*) FILTER (d = 'i') AS i, count(*) FILTER (d = 'o') AS o FROM (SELECT src AS id, 'o' AS d FROM edges WHERE kind = 'IMPLEMENTS' UNION ALL SELECT dst, 'i' FROM edges WHERE kind = 'IMPLEMENTS') GROUP BY id)")
def g17(spark, d):
    e = N.edges_of_kind(facts(spark, d), "IMPLEMENTS")
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    deg = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return deg.agg(F.count_if(F.col("i") == 0).alias("heads"), F.count_if(F.col("o") == 0).alias("tails"), F.max("i").alias("max_in"), F.max("o").alias("max_out"))


@query("g16_agent_condensation", graph=""", hops AS (SELECT src AS a, dst AS b FROM edges WHERE kind IN ('CONTAINS', 'IMPORTS') AND src <> dst),
    walk AS (SELECT id AS start, id AS node, 0 AS hop FROM nodes WHERE id LIKE 'region:%'
             UNION SELECT w.start, h.b, w.hop + 1 FROM walk w JOIN hops h ON h.a = w.node WHERE w.hop < 3 AND (w.hop = 0 OR w.node NOT LIKE 'supplier:%'))
    SELECT DISTINCT start, node AS next FROM walk WHERE node LIKE 'supplier:%'""")
def g16(spark, d):
    """Next suppliers that a region reaches through anything but suppliers, within three hops."""
    g = facts(spark, d)
    free = hops(g, "CONTAINS", "IMPORTS", reverse=False).where("a <> b").where(~F.col("a").startswith("supplier:"))
    roots = g.nodes.where(F.col("id").startswith("region:")).select("id")
    return T.reach(roots, free, 3).where(F.col("node").startswith("supplier:")).select("start", F.col("node").alias("next")).distinct()
