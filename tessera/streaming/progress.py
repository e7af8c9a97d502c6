"""What streams report of themselves, as rows in the shared folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.traversal import shared_root

SCHEMA = "query string, what string, batch long, rows long, at string"


class ProgressRows(StreamingQueryListener):
    """A small JSON file for each report, written through Spark's own file systems; use as a context.

    Only reports of queries with this ``name`` are kept. ``rows()`` reads them back, once the
    session's listeners have seen all that has happened. The folder goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.count = spark, name, 0
        self.runs: set[str] = set()
        self.path = f"{shared_root(spark)}/progress-{uuid.uuid4().hex}"
        self.jvm = spark.sparkContext._jvm
        folder = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(folder)
        self.files.deleteOnExit(folder)

    def __enter__(self) -> ProgressRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.settle()
        self.spark.streams.removeListener(self)

    def settle(self) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()

    def put(self, what: str, at: str, batch: int | None = None, rows: int | None = None) -> None:
        self.count += 1
        out = self.files.create(self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.count:06d}.json"))
        out.write(bytearray(json.dumps({"query": self.name, "what": what, "batch": batch, "rows": rows, "at": at}).encode()))
        out.close()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))
            self.put("started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) in self.runs:
            self.put("progress", p.timestamp, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        if str(event.runId) in self.runs:
            self.put("idle", event.timestamp)

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.runs:
            self.put("failed" if event.exception else "ended", "")

    def rows(self) -> DataFrame:
        self.settle()
        return self.spark.read.schema(SCHEMA).json(self.path)
