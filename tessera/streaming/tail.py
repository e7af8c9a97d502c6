"""The audit log as a stream: tail, run states, rate limits, time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traversal import shared_root

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tail(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """New events of ``folder``; file offsets make delivery exactly once, so equal timestamps are never lost."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; rows later than ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


def rate_limited(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """(user_id, event_id, allowed, retry_after): a token bucket for each user, refilled by elapsed time.

    State is two numbers a key; a bucket is made when its key is first seen and dropped
    when it has been idle long enough to be full again.
    """

    def take(key, batches, state):
        import pandas as pd

        tokens, at = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts in zip(rows["event_id"], rows["ts"]):
            now = ts.timestamp()
            tokens = capacity if at is None else min(capacity, tokens + max(0.0, now - at) * per_second)
            at = now if at is None else max(at, now)
            allowed = tokens >= 1
            out.append((key[0], event_id, allowed, 0.0 if allowed else (1 - tokens) / per_second))
            tokens -= allowed
        state.update((float(tokens), float(at)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "retry_after"])

    return events.groupBy("user_id").applyInPandasWithState(
        take, "user_id long, event_id long, allowed boolean, retry_after double", "tokens double, at double", "append", "NoTimeout"
    )


def due(pending: DataFrame, now: str) -> DataFrame:
    """Approvals whose time has run out at ``now``: the sweep that a schedule or ``foreachBatch`` runs (pk, created, after_seconds)."""
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("created").cast("timestamp"))
    return pending.where(F.col("after_seconds").isNotNull() & (age >= F.col("after_seconds"))).select("pk")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return a reader of what it wrote.

    Rows go to the session's shared folder, never through the driver; in complete mode the
    last batch holds all of them. The folder goes when the driver's JVM ends.
    """
    spark = stream.sparkSession
    base = f"{shared_root(spark)}/stream-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop)
    writer, last = stream.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{base}/state").trigger(availableNow=True), []
    if mode == "append":
        last.append(f"{base}/rows")
        query = writer.format("parquet").start(last[0])
    else:

        def keep(batch: DataFrame, k: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/rows-{k}")
            last[:] = [f"{base}/rows-{k}"]

        query = writer.foreachBatch(keep).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not last or not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last[0])):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(last[0])
