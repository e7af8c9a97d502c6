"""The fact graph, audit log and document views over the driver's relational tables.

The view definitions are plain SQL that Spark and the oracle read alike; what is computed
on them is not shared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NODE_KINDS = ("Module", "Type", "Function", "Field", "Endpoint", "Entity", "Doc", "Intent")
EDGE_KINDS = ("IMPORTS", "CONTAINS", "CALLS", "IMPLEMENTS", "READS", "WRITES", "EXPOSES", "CONSUMES", "REFERENCES", "MENTIONS", "SERVES")

NODES_SQL = """
SELECT 'region:' || CAST(r_regionkey AS STRING) AS id, 'Module' AS kind, lower(r_name) AS name, 'py' AS language,
       'src/' || lower(r_name) || '/__init__.py' AS file, CAST(1 AS BIGINT) AS line, CAST(1000 AS BIGINT) AS end_line,
       false AS external, CAST(r_regionkey AS BIGINT) AS seq
FROM region
UNION ALL
SELECT 'nation:' || CAST(n_nationkey AS STRING), 'Module', lower(r_name) || '.' || lower(n_name),
       CASE n_nationkey % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'java' ELSE 'ts' END,
       CASE WHEN n_nationkey % 12 = 11 THEN NULL ELSE 'src/' || lower(r_name) || '/' || lower(n_name) || '.py' END,
       CASE WHEN n_nationkey % 12 = 11 THEN NULL ELSE CAST(1 AS BIGINT) END,
       CASE WHEN n_nationkey % 12 = 11 THEN NULL ELSE CAST(100000 AS BIGINT) END,
       n_nationkey % 12 = 11, CAST(100 + n_nationkey AS BIGINT)
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'customer:' || CAST(c_custkey AS STRING), 'Type',
       CASE WHEN c_custkey % 7 = 0 THEN 'I' ELSE '' END || 'Customer' || CAST(c_custkey % 400 AS STRING) ||
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Controller' WHEN 'MACHINERY' THEN 'Service' WHEN 'HOUSEHOLD' THEN 'Repository'
                         WHEN 'AUTOMOBILE' THEN 'Error' ELSE 'Model' END,
       CASE c_custkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'go' ELSE 'java' END,
       CASE WHEN c_acctbal < 0 THEN NULL
            ELSE CASE WHEN c_custkey % 9 = 0 THEN 'tests/' ELSE 'src/' END || 'types_' || CAST(c_custkey % 50 AS STRING) || '.py' END,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_custkey / 50) * 20 + 1 AS BIGINT) END,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_custkey / 50) * 20 + 15 AS BIGINT) END,
       c_acctbal < 0, CAST(1000 + c_custkey AS BIGINT)
FROM customer
UNION ALL
SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'Type', 'Supplier' || CAST(s_suppkey AS STRING) || 'Service', 'go',
       CASE WHEN s_acctbal < 0 THEN NULL ELSE 'src/supply/s' || CAST(s_suppkey % 10 AS STRING) || '.go' END,
       CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(floor(s_suppkey / 10) * 30 + 1 AS BIGINT) END,
       CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(floor(s_suppkey / 10) * 30 + 29 AS BIGINT) END,
       s_acctbal < 0, CAST(100000000 + s_suppkey AS BIGINT)
FROM supplier
UNION ALL
SELECT 'part:' || CAST(p_partkey AS STRING), 'Function',
       CASE WHEN p_partkey % 11 = 0 THEN 'test_' WHEN p_partkey % 5 = 0 THEN '_' ELSE '' END || replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 300 AS STRING),
       CASE p_partkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'go' ELSE 'c' END,
       CASE WHEN p_size = 1 THEN NULL
            ELSE CASE WHEN p_partkey % 11 = 0 THEN 'tests/test_p' ELSE 'src/parts/p' END || CAST(p_partkey % 40 AS STRING) || '.py' END,
       CASE WHEN p_size = 1 THEN NULL ELSE CAST(floor(p_partkey / 40) * 10 + 1 AS BIGINT) END,
       CASE WHEN p_size = 1 THEN NULL ELSE CAST(floor(p_partkey / 40) * 10 + 4 + p_size AS BIGINT) END,
       p_size = 1, CAST(200000000 + p_partkey AS BIGINT)
FROM part
UNION ALL
SELECT 'order:' || CAST(o_orderkey AS STRING), 'Entity', 'order_' || CAST(o_orderkey AS STRING), 'sql',
       'db/o' || CAST(o_orderkey % 20 AS STRING) || '.sql', CAST(floor(o_orderkey / 20) + 1 AS BIGINT),
       CAST(floor(o_orderkey / 20) + 1 AS BIGINT), false, CAST(300000000 + o_orderkey AS BIGINT)
FROM orders
UNION ALL
SELECT DISTINCT 'endpoint:' || event_type, 'Endpoint', 'GET /' || event_type, 'py', 'src/api.py', CAST(1 AS BIGINT), CAST(9 AS BIGINT), false, CAST(90000 AS BIGINT)
FROM events
UNION ALL
SELECT 'doc:' || CAST(doc_id AS STRING), 'Doc', 'doc-' || CAST(doc_id AS STRING), lang, 'docs/' || source || '.md',
       CAST(doc_id + 1 AS BIGINT), CAST(doc_id + 1 AS BIGINT), false, CAST(400000000 + doc_id AS BIGINT)
FROM documents
UNION ALL
SELECT 'intent:' || CAST(item_id AS STRING), 'Intent', 'T-' || CAST(item_id AS STRING), '', NULL, NULL, NULL, false, CAST(500000000 + item_id AS BIGINT)
FROM benchmark
"""

EDGES_SQL = """
SELECT 'region:' || CAST(n_regionkey AS STRING) AS src, 'nation:' || CAST(n_nationkey AS STRING) AS dst, 'CONTAINS' AS kind,
       'src/world.py' AS file, CAST(n_nationkey AS BIGINT) AS line, CAST(n_nationkey AS BIGINT) AS seq
FROM nation
UNION ALL
SELECT 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), 'CONTAINS', 'src/world.py', CAST(c_custkey AS BIGINT), CAST(1000 + c_custkey AS BIGINT)
FROM customer
UNION ALL
SELECT 'nation:' || CAST(s_nationkey AS STRING), 'supplier:' || CAST(s_suppkey AS STRING), 'CONTAINS', 'src/world.py', CAST(s_suppkey AS BIGINT), CAST(100000000 + s_suppkey AS BIGINT)
FROM supplier
UNION ALL
SELECT 'supplier:' || CAST(p_partkey % 10 AS STRING), 'part:' || CAST(p_partkey AS STRING), 'CONTAINS', 'src/supply.go', CAST(p_partkey AS BIGINT), CAST(200000000 + p_partkey AS BIGINT)
FROM part
UNION ALL
SELECT CASE WHEN l_linenumber = 7 AND l_orderkey % 50 = 0 THEN 'ghost:' ELSE 'supplier:' END || CAST(l_suppkey AS STRING),
       'part:' || CAST(l_partkey AS STRING), 'CALLS', 'src/supply/s' || CAST(l_suppkey % 10 AS STRING) || '.go',
       CAST(l_orderkey * 8 + l_linenumber AS BIGINT), CAST(1000000000 + l_orderkey * 8 + l_linenumber AS BIGINT)
FROM lineitem
UNION ALL
SELECT 'part:' || CAST(l_partkey AS STRING), 'part:' || CAST(l_orderkey % 200 AS STRING), 'CALLS', 'src/parts/p' || CAST(l_partkey % 40 AS STRING) || '.py',
       CAST(l_orderkey AS BIGINT), CAST(2000000000 + l_orderkey AS BIGINT)
FROM lineitem WHERE l_linenumber = 1
UNION ALL
SELECT DISTINCT 'nation:' || CAST(c_nationkey AS STRING), 'nation:' || CAST(s_nationkey AS STRING), 'IMPORTS', 'src/world.py',
       CAST(l_orderkey AS BIGINT), CAST(3000000000 + l_orderkey * 8 + l_linenumber AS BIGINT)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE l_returnflag = 'R' AND l_quantity >= 49 AND l_discount >= 0.09 AND l_linenumber <= 3
UNION ALL
SELECT 'order:' || CAST(o_orderkey AS STRING), 'customer:' || CAST(o_custkey AS STRING), 'REFERENCES', 'db/o' || CAST(o_orderkey % 20 AS STRING) || '.sql',
       CAST(o_orderkey AS BIGINT), CAST(4000000000 + o_orderkey AS BIGINT)
FROM orders
UNION ALL
SELECT 'order:' || CAST(o_orderkey AS STRING), 'order:' || CAST(o_custkey AS STRING), 'REFERENCES', 'db/o' || CAST(o_orderkey % 20 AS STRING) || '.sql',
       CAST(o_orderkey + 1 AS BIGINT), CAST(5000000000 + o_orderkey AS BIGINT)
FROM orders WHERE o_orderkey % 3 = 0
UNION ALL
SELECT 'part:' || CAST(l_partkey AS STRING), 'order:' || CAST(l_orderkey AS STRING), CASE l_returnflag WHEN 'R' THEN 'READS' ELSE 'WRITES' END,
       'src/parts/p' || CAST(l_partkey % 40 AS STRING) || '.py', CAST(l_orderkey AS BIGINT), CAST(6000000000 + l_orderkey * 8 + l_linenumber AS BIGINT)
FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag IN ('R', 'A')
UNION ALL
SELECT 'customer:' || CAST(c_custkey AS STRING), 'customer:' || CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS STRING), 'IMPLEMENTS', 'src/types.py',
       CAST(c_custkey AS BIGINT), CAST(7000000000 + c_custkey AS BIGINT)
FROM customer WHERE c_custkey >= 1 AND c_custkey % 4 <> 3
UNION ALL
SELECT 'endpoint:' || event_type, 'part:' || CAST(event_id % 40 AS STRING), 'EXPOSES', 'src/api.py', CAST(min(event_id) AS BIGINT), CAST(8000000000 + min(event_id) AS BIGINT)
FROM events GROUP BY event_type, event_id % 40
UNION ALL
SELECT 'part:' || CAST(40 + event_id % 100 AS STRING), 'endpoint:' || event_type, 'CONSUMES', 'src/client.py', CAST(min(event_id) AS BIGINT), CAST(8000000000 + min(event_id) AS BIGINT)
FROM events GROUP BY event_type, event_id % 100
UNION ALL
SELECT 'doc:' || CAST(doc_id AS STRING), 'part:' || CAST((doc_id * 7) % 200 AS STRING), 'MENTIONS', 'docs/' || source || '.md', CAST(doc_id AS BIGINT), CAST(9000000000 + doc_id AS BIGINT)
FROM documents WHERE doc_id % 3 <> 0
UNION ALL
SELECT 'doc:' || CAST(doc_id AS STRING), 'customer:' || CAST(doc_id % 150 AS STRING), 'MENTIONS', 'docs/' || source || '.md', CAST(doc_id AS BIGINT), CAST(9500000000 + doc_id AS BIGINT)
FROM documents WHERE doc_id % 4 = 0
UNION ALL
SELECT 'part:' || CAST(item_id * 5 AS STRING), 'intent:' || CAST(item_id AS STRING), 'SERVES', 'src/parts.py', CAST(item_id AS BIGINT), CAST(9900000000 + item_id AS BIGINT)
FROM benchmark
"""

#: The audit log: one row an event; ``resource_id`` is the run.
AUDIT_SQL = """
SELECT event_id AS pk, ts, 't' || CAST(user_id % 3 AS STRING) AS tenant_id, 'u' || CAST(user_id AS STRING) AS actor, event_type AS action,
       CASE WHEN user_id % 2 = 0 THEN 'run' ELSE 'approval' END AS resource_type, 'r' || CAST(event_id % 500 AS STRING) AS resource_id,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'tr' || CAST(event_id % 250 AS STRING) END AS trace_id, value AS cost, props
FROM events
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Facts:
    """A property graph: nodes (id, kind, name, language, file, line, end_line, external, seq) and edges (src, dst, kind, file, line, seq)."""

    nodes: DataFrame
    edges: DataFrame


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


_SCHEMAS: dict[tuple[str, int], StructType] = {}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is asked of the files once for each time that they change, as that takes a job of its own."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    changed = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).getModificationTime()
    if (path, changed) not in _SCHEMAS:
        _SCHEMAS[path, changed] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path, changed]).parquet(path)


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for name in TABLES:
        if f" {name} " in text.replace("\n", " ") + " ":
            read_table(spark, f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(_sql(spark, sf_dir, NODES_SQL), _sql(spark, sf_dir, EDGES_SQL))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, AUDIT_SQL)
