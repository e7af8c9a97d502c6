"""Running sums in two levels, so that one key's rows are many tasks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .traversal import write_once


def running_sum(rows: DataFrame, by: str, order: tuple[str, ...], value: Column, name: str = "total", before: bool = False) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``by`` up to each, or with ``before`` ahead of it.

    Rows are dealt out by ranges of (``by``, ``order``), so a hot key lies in many parts; each part
    sums by itself, and starts at what the parts before it hold of its key, a number for each part
    and key. ``order`` must tell the rows of a key apart. Null values count as 0; null keys are one key.
    """
    key = F.col(by).asc_nulls_first()
    dealt = rows.withColumn("_v", F.coalesce(value, F.lit(0.0))).repartitionByRange(key, *order)
    parts = write_once(dealt.withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = parts.groupBy("_part", by).agg(F.sum("_v").alias("_t"))
    ahead = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = totals.select(F.col("_part").alias("_p"), F.col(by).alias("_k"), F.coalesce(F.sum("_t").over(ahead), F.lit(0.0)).alias("_start")).where("_start <> 0")
    summed = parts.withColumn("_sum", F.sum("_v").over(within)).join(starts, (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_k")), "left")
    total = F.coalesce("_start", F.lit(0.0)) + F.col("_sum") - (F.col("_v") if before else F.lit(0.0))
    return summed.select(*rows.columns, total.alias(name))
