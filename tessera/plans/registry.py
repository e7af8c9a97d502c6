"""All queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fact_tables import AUDIT_SQL, EDGES_SQL, NODES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GRAPH = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"
AUDIT = f"WITH RECURSIVE audit AS ({AUDIT_SQL})"


def query(name: str, sql: str | None = None, *, graph: str | None = None, audit: str | None = None, lists: tuple[str, ...] = ()):
    """Register a query; ``graph`` and ``audit`` are oracles that go on after those views' CTEs.

    Columns named in ``lists`` are arrays; they are compared as text, joined by bars.
    """

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        oracle = f"{GRAPH} {graph}" if graph is not None else f"{AUDIT} {audit}" if audit is not None else sql
        if lists:

            @wraps(f)
            def run(spark, d):
                return f(spark, d).withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in lists})

            QUERIES[name] = run
            texts = ", ".join(f"array_to_string({c}::VARCHAR[], '|') AS {c}" for c in lists)
            oracle = oracle and f"SELECT * REPLACE ({texts}) FROM ({oracle})"
        else:
            QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep
