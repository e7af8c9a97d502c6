"""Queries of call and base targets: names looked up through scopes, in files and rows that differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scopes as S
from ..operators.traversal import write_once
from ..sources import calls as C
from ..sources.syntax import scan_syntax
from .registry import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- Python: a file for each order, with a function for each of its lines

#: Names that functions bind, names that they call, and what classes extend.
BOUND = ("h0", "g1", "d0", "d1", "x", "y", "t", "f1")
CALLED = ("h0", "g1", "d0", "d1", "x", "len", "t.run", "f1", "self")
BASES = ("h0", "g1", "K0", "Exception", "lib.Base")


def pick(values, at):
    return f"element_at(array({', '.join(map(repr, values))}), CAST({at} AS INT) + 1)"


def picked(values, at):
    return f"[{', '.join(map(repr, values))}][({at})::INT + 1]"


def lines(choose):
    """What each function of an order's file looks like; one text for both engines but for how a value is picked."""
    return f"""SELECT l_orderkey AS o, l_linenumber AS n, {choose(BOUND, "l_suppkey % 8")} AS param, {choose(BOUND, "l_partkey % 8")} AS local_name,
        {choose(CALLED, "(l_partkey + l_suppkey + l_linenumber) % 9")} AS callee, {choose(BOUND, "(l_partkey + l_linenumber) % 8")} AS inner_param,
        (l_partkey + l_suppkey) % 3 = 0 AS nested, l_returnflag = 'R' AS in_class, {choose(BASES, "(l_suppkey + l_linenumber) % 5")} AS base,
        l_linenumber % 4 = 3 AND l_suppkey % 8 <> l_partkey % 8 AS shared
        FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) x"""


def order_files(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("scope_lines")
    rows = spark.sql(lines(pick).replace("FROM lineitem", "FROM scope_lines"))
    n, cat = F.col("n").cast("string"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    called = F.when(F.col("callee") == "self", cat("self.f", n)).otherwise(F.col("callee"))
    pad = F.when(F.col("in_class"), "    ").otherwise("")
    head = F.when(F.col("in_class"), cat("class C", n, "(", F.col("base"), "):\n    h0 = 1\n\n    def f", n, "(self, ", F.col("param"), "):\n")).otherwise(cat("def f", n, "(", F.col("param"), "):\n"))
    glob = F.when(F.col("shared"), cat(pad, "    global ", F.col("local_name"), "\n")).otherwise("")
    body = F.when(F.col("nested"), cat(pad, "    def inner(", F.col("inner_param"), "):\n", pad, "        return ", called, "(0)\n\n", pad, "    return inner\n")).otherwise(cat(pad, "    return ", called, "(0)\n"))
    text = cat(head, glob, pad, "    ", F.col("local_name"), " = 1\n", body, "\n\n")
    top = cat("from lib.m", (F.col("o") % 5).cast("string"), " import h0, h1 as g1\nimport tools as t\n\n\nclass K0:\n    pass\n\n\ndef d0():\n    return 1\n\n\ndef d1():\n    return h0(d0())\n\n\n")
    parts = rows.repartition(spark.sparkContext.defaultParallelism, "o").select("o", "n", text.alias("text")).groupBy("o").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p"))  # an order has seven lines at most
    return parts.select(cat("/r/src/shop/o", F.col("o").cast("string"), ".py").alias("path"), cat(top, F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("content"))


S05 = f"""WITH f AS ({lines(picked)}), own AS (SELECT *, 'py:shop.o' || o AS m, CASE WHEN in_class THEN 'py:shop.o' || o || '.C' || n || '.f' || n ELSE 'py:shop.o' || o || '.f' || n END AS src FROM f),
    plain AS (SELECT o FROM f WHERE n = 1 AND NOT in_class)
    SELECT src, dst FROM (
        SELECT src, CASE callee WHEN 'h0' THEN 'py:lib.m' || (o % 5) || '.h0' WHEN 'g1' THEN 'py:lib.m' || (o % 5) || '.h1' WHEN 'd0' THEN m || '.d0' WHEN 'd1' THEN m || '.d1'
            WHEN 't.run' THEN 'py:tools.run' WHEN 'f1' THEN CASE WHEN o IN (SELECT o FROM plain) THEN m || '.f1' END WHEN 'self' THEN CASE WHEN in_class THEN src END END AS dst,
            string_split(callee, '.')[1] AS head, param, CASE WHEN NOT shared THEN local_name END AS hidden, CASE WHEN nested THEN inner_param END AS deep FROM own)
    WHERE dst IS NOT NULL AND head <> param AND head IS DISTINCT FROM hidden AND head IS DISTINCT FROM deep
    UNION ALL SELECT 'py:shop.o' || o || '.d1', t FROM (SELECT DISTINCT o, unnest(['py:lib.m' || (o % 5) || '.h0', 'py:shop.o' || o || '.d0']) AS t FROM f)"""


@query("s05_resolved_calls", S05)
def s05(spark, d):
    """Calls of every order's file: through a name that a parameter, a local or an inner parameter hides, no edge."""
    rows = scan_syntax(order_files(spark, d)).where("what NOT IN ('set', 'base')").select(C.USED)
    return C.resolved_calls(write_once(rows)).select("src", "dst")


S07 = f"""SELECT 'py:shop.o' || o || '.C' || n AS src, CASE base WHEN 'h0' THEN 'py:lib.m' || (o % 5) || '.h0' WHEN 'g1' THEN 'py:lib.m' || (o % 5) || '.h1' WHEN 'K0' THEN 'py:shop.o' || o || '.K0' ELSE 'py:' || base END AS dst,
    base = 'Exception' AS external FROM ({lines(picked)}) WHERE in_class AND base <> 'lib.Base'"""


@query("s07_bases", S07)
def s07(spark, d):
    """Bases of every class: imported, of the module, or external; a dotted one is left alone."""
    rows = scan_syntax(order_files(spark, d)).where("what IN ('import', 'function', 'class', 'base')").select(C.USED)  # a base isn't hidden by a parameter or a local
    return C.resolved_bases(write_once(rows)).select("src", "dst", "external")


# --- other languages: calls, bindings and methods as rows; a file for every eight orders

CALLS = """SELECT 'o' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING) AS file, 'fn' || CAST(l_linenumber AS STRING) AS caller,
    CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'T' || CAST(l_suppkey % 7 AS STRING) END AS owner,
    CASE (l_partkey + l_suppkey) % 7 WHEN 0 THEN 'this' WHEN 1 THEN 'Part' || CAST(l_suppkey % 5 AS STRING) WHEN 2 THEN 'it' || CAST(l_suppkey % 5 AS STRING) WHEN 3 THEN 'ns' || CAST(l_suppkey % 3 AS STRING) || '::' ELSE NULL END AS holder,
    'g' || CAST(l_partkey % 12 AS STRING) AS name, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS line, l_partkey % 2 = 0 AS deep,
    'it' || CAST(l_linenumber % 5 AS STRING) AS receiver, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'shop.p' || CAST(l_orderkey % 4 AS STRING) END AS package FROM lineitem"""
#: Functions of a file, parameters of its functions, locals of an inner block, and imports by kind.
BINDS = """SELECT DISTINCT 'o' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING) AS file, '' AS fn, false AS deep, 'g' || CAST(l_partkey % 12 AS STRING) AS name, 'function' AS what FROM lineitem WHERE l_partkey % 5 = 0
    UNION ALL SELECT DISTINCT 'o' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING), 'fn' || CAST(l_linenumber AS STRING), false, 'g' || CAST(l_suppkey % 12 AS STRING), 'param' FROM lineitem WHERE l_suppkey % 2 = 0
    UNION ALL SELECT DISTINCT 'o' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING), 'fn' || CAST(l_linenumber AS STRING), true, 'g' || CAST(l_suppkey % 11 AS STRING), 'local' FROM lineitem WHERE l_suppkey % 3 = 0
    UNION ALL SELECT DISTINCT 'o' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING), '', false, 'it' || CAST(l_linenumber % 5 AS STRING), CASE l_linenumber % 2 WHEN 0 THEN 'namespace' ELSE 'import' END FROM lineitem WHERE l_partkey % 4 = 1
    UNION ALL SELECT DISTINCT 'o' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING), '', false, 'g' || CAST(l_suppkey % 12 AS STRING), 'import' FROM lineitem WHERE l_partkey % 7 = 2"""
METHODS = "SELECT DISTINCT 'T' || CAST(s_suppkey % 7 AS STRING) AS owner, 'g' || CAST(s_suppkey % 12 AS STRING) AS name FROM supplier WHERE s_suppkey % 5 < 2"
TYPES = "SELECT DISTINCT 'o' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING) AS file, 'Part' || CAST(l_suppkey % 5 AS STRING) AS name, 'java:lib.q' || CAST(l_suppkey % 5 AS STRING) || '.Part' AS target FROM lineitem WHERE l_suppkey % 5 < 2"
FOUND = f"WITH c AS ({CALLS}), b AS ({BINDS}), m AS ({METHODS}), t AS ({TYPES}), s AS (SELECT c.*, m.owner IS NOT NULL AS sibling, c.owner || '.' || c.name AS own FROM c LEFT JOIN m ON m.owner = c.owner AND m.name = c.name)"


def has(what, name="s.name"):
    return f"EXISTS (SELECT 1 FROM b WHERE b.file = s.file AND b.what = '{what}' AND b.name = {name})"


def parts(spark, d):
    """calls with their chain, binds with their scope, methods and imported types."""
    for name in ("lineitem", "supplier"):
        table(spark, d, name).createOrReplaceTempView(f"scope_{name}")
    read = lambda sql: spark.sql(sql.replace("FROM lineitem", "FROM scope_lineitem").replace("FROM supplier", "FROM scope_supplier"))
    function = F.concat_ws(":", "file", "caller")
    chain = F.when(F.col("deep"), F.array(F.concat(function, F.lit(":b")), function, F.col("file"))).otherwise(F.array(function, F.col("file")))
    scope = F.when(F.col("fn") == "", F.col("file")).when(F.col("deep"), F.concat(F.concat_ws(":", "file", "fn"), F.lit(":b"))).otherwise(F.concat_ws(":", "file", "fn"))
    target = F.when(F.col("what").isin("function"), F.concat_ws("::", "file", "name")).when(F.col("what").isin("import", "namespace"), F.concat(F.lit("lib/"), "name"))
    return read(CALLS).withColumn("chain", chain), read(BINDS).select("file", scope.alias("scope"), "name", "what", target.alias("target")), read(METHODS), read(TYPES)


OUT = ["file", "line", "target"]


@query("s72_c_calls", f"""{FOUND} SELECT file, line, CASE WHEN {has("function")} THEN file || '::' || name ELSE 'c:' || name END AS target FROM s WHERE holder IS NULL
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.file = s.file AND b.fn = s.caller AND b.name = s.name AND b.what IN ('param', 'local') AND (s.deep OR NOT b.deep))""")
def s72(spark, d):
    """Calls of global names; one that the function, or the block around the call, binds is a pointer."""
    calls, binds, _, _ = parts(spark, d)
    return S.c_targets(calls, binds).select(*OUT)


@query("s65_java_calls", f"""{FOUND} SELECT * FROM (SELECT s.file, s.line, CASE WHEN holder IS NULL OR holder = 'this' THEN CASE WHEN sibling THEN own END WHEN holder LIKE 'Part%' THEN coalesce(t.target, CASE WHEN package <> '' THEN 'java:' || package || '.' || holder END) || '.' || s.name END AS target
    FROM s LEFT JOIN t ON t.file = s.file AND t.name = s.holder) WHERE target IS NOT NULL""")
def s65(spark, d):
    calls, _, methods, types = parts(spark, d)
    return S.java_targets(calls, methods, types).select(*OUT)


@query("s68_ts_calls", f"""{FOUND} SELECT * FROM (SELECT file, line, CASE WHEN holder IS NULL THEN CASE WHEN {has("function")} THEN file || '::' || name WHEN {has("import")} THEN 'lib/' || name || '.' || name END
    WHEN holder = 'this' THEN CASE WHEN sibling THEN own END WHEN {has("namespace", "s.holder")} THEN 'lib/' || holder || '.' || name END AS target FROM s) WHERE target IS NOT NULL""")
def s68(spark, d):
    calls, binds, methods, _ = parts(spark, d)
    return S.ts_targets(calls, binds, methods).select(*OUT)


@query("s75_cpp_calls", f"""{FOUND} SELECT * FROM (SELECT file, line, CASE WHEN holder IS NULL THEN CASE WHEN sibling THEN owner || '::' || name WHEN {has("function")} THEN file || '::' || name ELSE 'cpp:' || name END
    WHEN holder = 'this' THEN CASE WHEN sibling THEN owner || '::' || name END WHEN holder LIKE '%::' THEN 'cpp:' || holder || name END AS target FROM s) WHERE target IS NOT NULL""")
def s75(spark, d):
    calls, binds, methods, _ = parts(spark, d)
    return S.cpp_targets(calls, binds, methods).select(*OUT)


@query("s81_go_calls", f"""{FOUND} SELECT * FROM (SELECT file, line, CASE WHEN holder IS NULL THEN CASE WHEN {has("function")} THEN file || '::' || name END WHEN holder = receiver AND sibling THEN own END AS target FROM s) WHERE target IS NOT NULL""")
def s81(spark, d):
    calls, binds, methods, _ = parts(spark, d)
    return S.go_targets(calls, binds, methods).select(*OUT)
