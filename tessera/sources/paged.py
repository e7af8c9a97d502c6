"""Document services that answer in pages, read from their saved responses.

A response is one JSON text: ``items`` (id, title, text, parent), and ``next``, the page that follows,
or null. A partition of the source is a range of pages: its task opens the first of them,
follows ``next`` to the range's end, and reads no page of another, so a lost task re-reads its
own pages only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, title string, text string, parent string"


class PageRange(InputPartition):
    def __init__(self, first: int, stop: int) -> None:
        self.first, self.stop = first, stop


def _folder(path: str):
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    return files, root.rstrip("/")


class PagedReader(DataSourceReader):
    def __init__(self, path: str, ranges: int) -> None:
        self.path, self.ranges = path, ranges

    def partitions(self) -> list[PageRange]:
        """Only page numbers are listed here; no response is opened."""
        from pyarrow import fs

        files, root = _folder(self.path)
        found = files.get_file_info(fs.FileSelector(root))
        pages = sorted(int(f.base_name.removeprefix("page=")) for f in found if f.base_name.startswith("page="))
        size = -(-len(pages) // self.ranges) if pages else 1
        cut = [pages[k : k + size] for k in range(0, len(pages), size)]
        return [PageRange(c[0], c[-1] + 1) for c in cut]

    def read(self, partition: PageRange) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        files, root = _folder(self.path)
        page: int | None = partition.first
        while page is not None and page < partition.stop:
            held = [f for f in files.get_file_info(fs.FileSelector(f"{root}/page={page}")) if f.base_name.startswith("part-")]
            response = {}
            for f in held:
                with files.open_input_stream(f.path) as body:
                    for line in body.read().decode().splitlines():
                        response = json.loads(line)
            items = response.get("items", [])
            yield pa.RecordBatch.from_pydict({c: pa.array([i.get(c) for i in items], pa.string()) for c in ("id", "title", "text", "parent")})
            page = response.get("next")


class PagedDocuments(DataSource):
    """``spark.read.format("paged_documents").option("path", folder).option("ranges", 8).load()``"""

    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["path"], int(self.options.get("ranges", 8)))


def read_pages(spark: SparkSession, path: str, ranges: int = 8) -> DataFrame:
    spark.dataSource.register(PagedDocuments)
    return spark.read.format("paged_documents").option("path", path).option("ranges", ranges).load()


def save_pages(items: DataFrame, path: str, pages: int, page: Column) -> None:
    """Write ``items`` (id, title, text, parent) as the responses of a service: ``page`` says on which of ``pages`` an item stands, in order of id."""
    numbers = items.sparkSession.range(pages).select(F.col("id").cast("int").alias("page"))
    answer = F.array_sort(F.collect_list(F.struct("id", "title", "text", "parent")))
    held = items.withColumn("page", page.cast("int")).groupBy("page").agg(answer.alias("items"))
    following = F.when(F.col("page") + 1 < pages, F.col("page") + 1).alias("next")
    rows = numbers.join(held, "page", "left").select("page", F.to_json(F.struct(F.coalesce("items", F.array()).alias("items"), following)).alias("value"))
    rows.write.partitionBy("page").text(path)
