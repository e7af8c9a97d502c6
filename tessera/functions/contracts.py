"""User code under a contract: table functions by id and version, called from SQL.

A contract is a Python table function: a class whose ``eval`` takes a row and yields rows, one
instance for each partition of its input, so it may keep state from row to row and add rows
in ``terminate``. SQL calls it by name with ``PARTITION BY`` and ``ORDER BY``, and whatever is to be
done with all its rows together is an ordinary aggregate after the call.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    id: str
    version: int
    returns: str
    handler: type
    finish: Callable[[DataFrame], DataFrame] | None = None

    @property
    def name(self) -> str:
        """What SQL calls it: the id's words and its version."""
        return f"{sql_name(self.id)}_v{self.version}"


_CONTRACTS: dict[tuple[str, int], Contract] = {}


def sql_name(contract_id: str) -> str:
    return re.sub(r"\W+", "_", contract_id)


def contract(contract_id: str, version: int, returns: str, finish: Callable[[DataFrame], DataFrame] | None = None):
    """Register a handler class; the last one registered under an id and version holds.

    ``returns``: the rows it yields, as DDL. ``finish``: a pass over all its rows (see :func:`run`).
    """

    def keep(handler: type) -> type:
        _CONTRACTS[contract_id, version] = Contract(contract_id, version, returns, handler, finish)
        return handler

    return keep


def latest(contract_id: str) -> Contract:
    versions = [v for i, v in _CONTRACTS if i == contract_id]
    if not versions:
        raise KeyError(f"nobody has registered {contract_id}")
    return _CONTRACTS[contract_id, max(versions)]


def install(spark: SparkSession) -> None:
    """Make every contract a table function of the session: ``id_v1``, and ``id`` for the highest version."""
    for (contract_id, version), c in _CONTRACTS.items():
        function = F.udtf(c.handler, returnType=c.returns)
        spark.udtf.register(c.name, function)
        if version == latest(contract_id).version:
            spark.udtf.register(sql_name(contract_id), F.udtf(c.handler, returnType=c.returns))


def run(rows: DataFrame, contract_id: str, version: int | None = None, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """A contract's rows over ``rows``, partitioned and ordered, with its finishing pass, if it has one."""
    c = latest(contract_id) if version is None else _CONTRACTS[contract_id, version]
    spark = rows.sparkSession
    install(spark)
    clause = (f" PARTITION BY ({', '.join(by)})" if by else "") + (f" ORDER BY ({', '.join(order)})" if order else "")
    made = spark.sql(f"SELECT * FROM {c.name}(TABLE(SELECT * FROM {{rows}}){clause})", rows=rows)
    return c.finish(made) if c.finish else made
