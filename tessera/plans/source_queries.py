"""Queries of web front-ends, page trees, blame, catalogs, saved facts, name resolution and declared rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import gap_findings
from ..operators.traversal import scratch
from ..operators.resolve import package_placeholders, resolve_includes, resolve_types, unique_basenames
from ..sources import code, exports, orm, stores, web
from ..sources.fact_tables import facts
from . import graph_queries, text_queries  # noqa: F401  their oracles are used below
from .io_queries import table
from .registry import ORACLES, QUERIES, query


def web_files(spark, d):
    """Three files a supplier: a router, an app that mounts it (every other supplier), and a client."""
    k = F.col("s_suppkey").cast("string")
    router = F.concat(
        F.lit('from fastapi import APIRouter\nrouter = APIRouter(prefix="/v1")\n\n\n@router.get("/items'), k,
        F.lit('/")\ndef items():\n    return 1\n\n\n@router.post(PATH + "/x")\ndef computed():\n    return 2\n\n\nclass V:\n    @router.route("/" + "both", methods=["POST", "PUT"])\n    def both(self):\n        return 3\n'),
    )
    app = F.concat(F.lit("from shop.routes"), k, F.lit(' import router as r\n\n\ndef make(app):\n    app.include_router(r, prefix="/api'), k, F.lit('/")\n'))
    client = F.concat(
        F.lit('import httpx\n\n\ndef load():\n    return httpx.get("http://h:80/api'), k, F.lit("/v1/items"), k,
        F.lit('?q=1")\n\n\ndef other(c):\n    with c as x:\n        return x.request("PUT", "/v1/both/")\n\n\ndef third(f):\n    return httpx.get("/nowhere"), httpx.get(f)\n'),
    )
    file = lambda kind, body: F.struct(F.concat(F.lit(f"/r/src/shop/{kind}"), k, F.lit(".py")).alias("path"), body.alias("content"))
    files = F.when(F.col("s_suppkey") % 2 == 0, F.array(file("routes", router), file("app", app), file("client", client)))
    return table(spark, d, "supplier").select(F.explode(F.coalesce(files, F.array(file("routes", router), file("client", client)))).alias("f")).select("f.*")


ENDPOINTS = """(SELECT e[1] AS verb, CASE WHEN s_suppkey % 2 = 0 THEN '/api' || CAST(s_suppkey AS STRING) ELSE '' END || '/v1/' || replace(e[2], '#', CAST(s_suppkey AS STRING)) AS path,
    'shop.routes' || CAST(s_suppkey AS STRING) || '.' || e[3] AS handler
    FROM supplier, (SELECT string_split(unnest(['GET|items#|items', 'POST|both|V.both', 'PUT|both|V.both']), '|') AS e))"""


@query("s85_endpoints", f"SELECT * FROM {ENDPOINTS}")
def s85(spark, d):
    return web.endpoints(web.scan_web(web_files(spark, d))).select("verb", "path", "handler")


@query(
    "s84_client_calls",
    f"""SELECT c.* FROM (SELECT 'shop.client' || CAST(s_suppkey AS STRING) || '.' || e[1] AS caller, e[2] AS verb, replace(e[3], '#', CAST(s_suppkey AS STRING)) AS path
        FROM supplier, (SELECT string_split(unnest(['load|GET|/api#/v1/items#', 'other|PUT|/v1/both', 'third|GET|/nowhere']), '|') AS e)) c
        WHERE (c.verb, c.path) IN (SELECT (verb, path) FROM {ENDPOINTS})""",
)
def s84(spark, d):
    return web.consumes(web.scan_web(web_files(spark, d))).select("caller", "verb", "path")


@query(
    "s46_page_tree",
    """WITH pages AS (SELECT 'region:1' AS id, 0 AS depth UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), 1 FROM nation WHERE n_regionkey = 1
        UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
        UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)
        SELECT id, depth, (SELECT count(*) FROM pages) > 60 AS truncated FROM pages ORDER BY depth, id LIMIT 60""",
)
def s46(spark, d):
    """A page tree, at most 60 pages and two levels deep, as the feature has it; also the trees of S47, S48 and S50."""
    contains = facts(spark, d).edges.where("kind = 'CONTAINS'").select(F.col("src").alias("parent"), F.col("dst").alias("id"))
    return stores.fetch_tree(contains, "region:1", 2, 60)


@query("s42_blame", "SELECT o_orderkey, unnest([1::BIGINT, 2::BIGINT]) AS line, unnest([md5(CAST(o_custkey AS STRING)), md5(CAST(o_orderkey AS STRING))]) || 'abcdef01' AS sha FROM orders")
def s42(spark, d):
    sha = lambda c: F.concat(F.md5(F.col(c).cast("string")), F.lit("abcdef01"))
    text = F.concat(sha("o_custkey"), F.lit(" 3 1 1\nauthor A\nsummary 9 9\n\tx = 1\n"), sha("o_orderkey"), F.lit(" 7 2\nauthor B\n\ty = 2\n"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(stores.blame_lines(text)).alias("b")).select("o_orderkey", "b.line", "b.sha")


DDL = [
    "CREATE TABLE {db}.area (id INT NOT NULL, name STRING) USING parquet",
    "CREATE TABLE {db}.item (id INT, area_id INT, price DECIMAL(10, 2)) USING parquet",
    "CREATE VIEW {db}.dear AS SELECT id, price FROM {db}.item WHERE price > 10",
    "CREATE TABLE {db}.area (id INT) USING parquet",
    "CREATE TABLE {db}.never (id INT) USING parquet",
]


@query("s36_describe_tables", "SELECT e[1] AS t, e[2] = 'view' AS is_view, e[3] AS name, e[4] AS type FROM (SELECT string_split(unnest(['area|table|id|int', 'area|table|name|string', 'item|table|id|int', 'item|table|area_id|int', 'item|table|price|decimal(10,2)', 'dear|view|id|int', 'dear|view|price|decimal(10,2)']), '|') AS e)")
def s36(spark, d):
    rows = stores.try_ddl(spark, DDL)[2]
    return spark.createDataFrame(rows, "t string, is_view boolean, name string, type string, nullable boolean").drop("nullable")


@query("s37_try_ddl", "SELECT 3::BIGINT AS done, true AS failed")
def s37(spark, d):
    done, error, _ = stores.try_ddl(spark, DDL)
    return spark.createDataFrame([(done, "ALREADY_EXISTS" in error)], "done long, failed boolean")


@query("s38_saved_edges", graph="SELECT src, dst, line FROM edges WHERE kind = 'IMPORTS'")
def s38(spark, d):
    """One kind of saved facts: only its files are opened."""
    path = scratch(spark, "facts")
    exports.save(facts(spark, d), path)
    return exports.load(spark, path).edges.where("kind = 'IMPORTS'").select("src", "dst", "line")


@query("s39_fact_cache", graph="SELECT kind, count(*) AS n, false AS first_hit, true AS second_hit FROM nodes GROUP BY kind")
def s39(spark, d):
    def never():
        raise AssertionError("saved facts are built again")

    folder = scratch(spark, "cache")
    _, first = stores.load_or_build(spark, folder, "c0ffee", "v1", lambda: facts(spark, d))
    again, second = stores.load_or_build(spark, folder, "c0ffee", "v1", never)
    return again.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumns({"first_hit": F.lit(first), "second_hit": F.lit(second)})


def type_references(spark, d):
    key = F.col("o_orderkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    refs = table(spark, d, "orders").select(
        key.alias("ref"), text("n", key % 25).alias("package"), text("f", key % 50).alias("file"), F.when(key % 10 == 0, "x.Y").otherwise(text("C", key % 60)).alias("name")
    )
    customer, custkey = table(spark, d, "customer"), F.col("c_custkey")
    types = customer.select(text("n", F.col("c_nationkey")).alias("package"), text("C", custkey % 60).alias("name"))
    imports = customer.where(custkey % 5 == 0).select(
        text("f", custkey % 50).alias("file"), text("C", custkey % 40).alias("name"), F.concat(F.when(custkey % 14 == 0, "alt.").otherwise("lib."), text("C", custkey % 40)).alias("target")
    )
    return refs, types, imports


RESOLVE = """WITH refs AS (SELECT o_orderkey AS ref, 'n' || CAST(o_orderkey % 25 AS STRING) AS package, 'f' || CAST(o_orderkey % 50 AS STRING) AS file,
        CASE WHEN o_orderkey % 10 = 0 THEN 'x.Y' ELSE 'C' || CAST(o_orderkey % 60 AS STRING) END AS name FROM orders),
    types AS (SELECT DISTINCT 'n' || CAST(c_nationkey AS STRING) AS package, 'C' || CAST(c_custkey % 60 AS STRING) AS name FROM customer),
    imports AS (SELECT 'f' || CAST(c_custkey % 50 AS STRING) AS file, 'C' || CAST(c_custkey % 40 AS STRING) AS name,
        min(CASE WHEN c_custkey % 14 = 0 THEN 'alt.' ELSE 'lib.' END || 'C' || CAST(c_custkey % 40 AS STRING)) AS target FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1, 2 HAVING count(DISTINCT c_custkey % 14 = 0) = 1)
    SELECT ref, CASE WHEN contains(r.name, '.') THEN r.name WHEN i.target IS NOT NULL THEN i.target WHEN t.name IS NOT NULL THEN t.package || '.' || t.name {more} END AS type
    FROM refs r LEFT JOIN imports i ON i.file = r.file AND i.name = r.name LEFT JOIN types t ON t.package = r.package AND t.name = r.name"""


@query("s66_resolve_types", RESOLVE.format(more=""))
def s66(spark, d):
    return resolve_types(*type_references(spark, d)).select("ref", "type")


@query(
    "s76_resolve_unique_names",
    RESOLVE.format(more="ELSE u.full_name") + " LEFT JOIN (SELECT name, min(package || '.' || name) AS full_name FROM types GROUP BY name HAVING count(*) = 1) u ON u.name = r.name",
)
def s76(spark, d):
    return resolve_types(*type_references(spark, d), unique_simple=True).select("ref", "type")


@query(
    "s70_placeholders",
    """WITH t AS (SELECT DISTINCT 'ts:pkg' || CAST(user_id % 7 AS STRING) AS module, event_type AS name FROM events WHERE user_id % 3 = 0)
        SELECT module || ':' || name AS id, 'Function' AS kind, name FROM t UNION ALL SELECT DISTINCT module, 'Module', substr(module, 4) FROM t""",
)
def s70(spark, d):
    package = F.concat(F.lit("ts:pkg"), (F.col("user_id") % 7).cast("string"), F.lit(":"), "event_type")
    target = F.when(F.col("user_id") % 3 == 0, package).otherwise(F.concat(F.lit("ts:src/"), "event_type"))
    return package_placeholders(table(spark, d, "events").select(target.alias("id")))


@query("s71_prototypes", "SELECT 'c:f' || CAST(o_custkey AS STRING) AS id, min(o_orderkey % 4 <> 0) AS external, CASE WHEN min(o_orderkey % 4 <> 0) THEN 'a.h' ELSE 'b.c' END AS path FROM orders GROUP BY o_custkey")
def s71(spark, d):
    """A prototype is a placeholder of its definition; the definition's row stays where there is one."""
    proto = F.col("o_orderkey") % 4 != 0
    none = F.lit(None).cast("long")
    rows = table(spark, d, "orders").select(
        F.lit("node").alias("what"), F.concat(F.lit("c:f"), F.col("o_custkey").cast("string")).alias("id"), F.lit("Function").alias("kind"), F.lit("f").alias("name"),
        F.when(proto, "a.h").otherwise("b.c").alias("path"), F.lit(1).cast("long").alias("line"), none.alias("end_line"), proto.alias("external"),
    )
    return code.merged_nodes(rows).select("id", "external", "path")


RULES = [
    {"id": "described", "description": "a text", "severity": "blocker", "check": "min_length", "field": "text", "length": 10},
    {"id": "scoped", "description": "a scope", "severity": "warning", "check": "field_present", "field": "scope"},
    {"id": "settled", "description": "no open questions", "severity": "needs_input", "check": "max_items", "field": "questions", "count": 0},
    {"id": "limits", "description": "one limit at least", "severity": "warning", "check": "min_items", "field": "limits", "count": 1},
]


@query(
    "e06_declared_rules",
    """SELECT id, r[1] AS rule, r[2] AS severity FROM (SELECT doc_id AS id, string_split(unnest(list_filter([
        CASE WHEN length(trim(coalesce(text, ''), ' ')) < 10 THEN 'described|blocker' END, CASE WHEN source IS NULL OR source = 'src1' THEN 'scoped|warning' END,
        CASE WHEN doc_id % 3 > 0 THEN 'settled|needs_input' END, CASE WHEN doc_id % 2 = 0 THEN 'limits|warning' END], lambda x: x IS NOT NULL)), '|') AS r FROM documents)""",
)
def e06(spark, d):
    times = lambda n: F.array_repeat(F.lit("q"), (F.col("doc_id") % n).cast("int"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.nullif("source", F.lit("src1")).alias("scope"), times(3).alias("questions"), times(2).alias("limits"))
    return gap_findings(rows, RULES).select("id", "rule", "severity")


@query("e17_regression_gaps", f"SELECT node FROM ({ORACLES['g05_regression_plan']}) WHERE NOT covered")
def e17(spark, d):
    """Impacted symbols that no test reaches."""
    return QUERIES["g05_regression_plan"](spark, d).where("NOT covered").select("node")


@query("e19_map", graph="SELECT kind, count(*) AS nodes, count(*) FILTER (external) AS external, sum(coalesce(e.n, 0))::BIGINT AS edges_out FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) e ON e.src = id GROUP BY kind")
def e19(spark, d):
    """What a repository holds: nodes, placeholders and outgoing edges by kind."""
    g = facts(spark, d)
    out = g.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = g.nodes.join(out, "id", "left")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("external").alias("external"), F.sum(F.coalesce("n", F.lit(0))).alias("edges_out"))


def orm_files(spark, d):
    """A file of mapped classes and one that queries them, for each nation."""
    k = F.col("n_nationkey").cast("string")
    models = F.concat(
        F.lit("from db import Base, models\n\n\nclass Order"), k, F.lit('(Base):\n    __tablename__ = "orders'), k,
        F.lit('"\n    id = Column(Integer)\n    note: Mapped[str]\n    buyer = mapped_column(ForeignKey("buyers.id"))\n    lines = relationship("Line")\n    own = Column(ForeignKey("orders'), k,
        F.lit('.id"))\n\n\nclass Line'), k, F.lit("(models.Model):\n    order = models.ForeignKey(Order"), k, F.lit(", on_delete=1)\n    tags = models.ManyToManyField('x.Missing')\n    n = models.IntegerField()\n    helper = 3\n\n\nclass Plain:\n    __tablename__ = make()\n    id = Column(Integer)\n"),
    )
    used = F.concat(
        F.lit("def read(db):\n    def inner():\n        return db.execute(delete(Line"), k, F.lit("))\n    return db.execute(select(Order"), k, F.lit(").where(1))\n\n\nselect(Order"), k, F.lit(")\n\n\ndef write(db):\n    return insert(Plain), update(text)\n"),
    )
    both = F.array(F.struct(F.lit("models"), models), F.struct(F.lit("store"), used))
    files = table(spark, d, "nation").select(k.alias("k"), F.explode(both).alias("f"))
    return files.select(F.concat(F.lit("/r/src/shop/a"), "k", F.lit("/"), "f.col1", F.lit(".py")).alias("path"), F.col("f.col2").alias("content"))


@query(
    "s83_mapped_classes",
    """SELECT e[1] AS src, e[2] AS dst, e[3] AS kind FROM (SELECT string_split(replace(unnest(['py:shop.a#.models|py:entity:orders#|CONTAINS', 'py:shop.a#.models|py:entity:a#_line#|CONTAINS',
        'py:entity:orders#|py:entity:orders#.id|CONTAINS', 'py:entity:orders#|py:entity:orders#.note|CONTAINS', 'py:entity:orders#|py:entity:orders#.buyer|CONTAINS', 'py:entity:orders#|py:entity:orders#.own|CONTAINS',
        'py:entity:a#_line#|py:entity:a#_line#.order|CONTAINS', 'py:entity:a#_line#|py:entity:a#_line#.tags|CONTAINS', 'py:entity:a#_line#|py:entity:a#_line#.n|CONTAINS',
        'py:entity:orders#|py:entity:buyers|REFERENCES', 'py:entity:a#_line#|py:entity:orders#|REFERENCES', 'py:shop.a#.store.read.inner|py:entity:a#_line#|WRITES', 'py:shop.a#.store.read|py:entity:orders#|READS']),
        '#', CAST(n_nationkey AS STRING)), '|') AS e FROM nation)""",
)
def s83(spark, d):
    return orm.data_edges(orm.scan_orm(orm_files(spark, d))).select("src", "dst", "kind")


@query("s74_header_index", "SELECT 'h' || CAST(s_suppkey AS STRING) || '.h' AS base, 'inc/n' || CAST(s_nationkey AS STRING) || '/h' || CAST(s_suppkey AS STRING) || '.h' AS file FROM supplier")
def s74(spark, d):
    """Base names of headers that one file only has; every nation's ``common.h`` is nobody's."""
    return unique_basenames(header_files(spark, d))


def header_files(spark, d):
    nation, k = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    own = table(spark, d, "supplier").select(F.concat(F.lit("inc/n"), nation, F.lit("/h"), k, F.lit(".h")).alias("file"))
    common = table(spark, d, "nation").select(F.concat(F.lit("inc/n"), F.col("n_nationkey").cast("string"), F.lit("/common.h")).alias("file"))
    return own.unionByName(common)


@query(
    "s73_includes_by_path",
    """SELECT s_suppkey, e[1] AS include, CASE WHEN e[2] <> '-' THEN replace(replace(e[2], '#', CAST(s_nationkey AS STRING)), '@', CAST(s_suppkey AS STRING)) END AS target
        FROM (SELECT s_suppkey, s_nationkey, string_split(unnest(['common.h|inc/n#/common.h', './../n0/common.h|inc/n0/common.h', 'inc/n0/common.h|inc/n0/common.h', 'far/h1.h|' || (SELECT min('inc/n' || CAST(s_nationkey AS STRING) || '/h1.h') FROM supplier WHERE s_suppkey = 1),
            '../../../common.h|-', 'other/common.h|-']), '|') AS e FROM supplier)""",
)
def s73b(spark, d):
    folder = F.concat(F.lit("inc/n"), F.col("s_nationkey").cast("string"), F.lit("/main.c"))
    asked = F.array(*map(F.lit, ("common.h", "./../n0/common.h", "inc/n0/common.h", "far/h1.h", "../../../common.h", "other/common.h")))
    includes = table(spark, d, "supplier").select("s_suppkey", folder.alias("file"), F.explode(asked).alias("include"))
    return resolve_includes(includes, header_files(spark, d)).select("s_suppkey", "include", "target")


def scanners():
    """Every registered scanner under one shape: (scanner, place, rule)."""
    place = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c])
    yield "secrets", "c15_secrets", place("doc_id", "line_no")
    yield "security", "c16_security", place("page_id")
    yield "style", "c17_style", place("doc_id", "line_no")


@query(
    "e08_all_scanners",
    f"SELECT 'secrets' AS scanner, CAST(doc_id AS STRING) || ':' || CAST(line_no AS STRING) AS place, rule FROM ({ORACLES['c15_secrets']}) UNION ALL SELECT 'security', CAST(page_id AS STRING), rule FROM ({ORACLES['c16_security']}) "
    f"UNION ALL SELECT 'style', CAST(doc_id AS STRING) || ':' || CAST(line_no AS STRING), rule FROM ({ORACLES['c17_style']})",
)
def e08(spark, d):
    """All scanners' findings in one table, each scanner a function from rows to rows (E09)."""
    parts = [QUERIES[q](spark, d).select(F.lit(name).alias("scanner"), at.alias("place"), "rule") for name, q, at in scanners()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
