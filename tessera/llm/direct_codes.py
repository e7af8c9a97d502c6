"""Token ids as directly addressable codes.

An id is split into chunks of ``chunk_bits`` bits, lowest first. Level k holds the k-th
chunks of all ids that have one, and a bitmap with a bit for each of them that says whether
the id goes on; a rank directory counts the set bits before each 512-bit block. So the i-th
id is read with one lookup a level, without decoding anything around it.

A segment is one such file (header, then for each level: count, chunks, bitmap, directory)
with the documents it holds. Segments are rows of a table written by Spark's own writer,
in ascending id order, so a lost task is simply run again and nothing is left half-written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .tokens import encoder as shared_encoder
from .tokens import small_batches

MAGIC = b"DAC1"
BLOCK = 512


def encode_codes(ids: np.ndarray, chunk_bits: int = 8) -> bytes:
    """The file for ``ids``, unsigned 32-bit integers; ``chunk_bits`` is 8 or 16."""
    if chunk_bits not in (8, 16):
        raise ValueError("chunk_bits is 8 or 16")
    kind = "<u1" if chunk_bits == 8 else "<u2"
    left = ids.astype(np.uint32)
    levels = []
    while True:
        chunks = (left & np.uint32((1 << chunk_bits) - 1)).astype(kind)
        higher = left >> np.uint32(chunk_bits)
        more = higher > 0
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (BLOCK // 8)))
        ones = np.bitwise_count(bitmap).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append((len(chunks), chunks.tobytes(), bitmap.tobytes(), directory.tobytes()))
        left = higher[more]
        if not len(left):
            break
    head = MAGIC + struct.pack("<BBQ", chunk_bits, len(levels), len(ids))
    return head + b"".join(struct.pack("<QIII", n, len(c), len(b), len(d)) + c + b + d for n, c, b, d in levels)


class DirectCodes:
    """Reader of one file; nothing is decoded before it is asked for."""

    def __init__(self, body: bytes) -> None:
        if body[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.chunk_bits, count, self.length = struct.unpack_from("<BBQ", body, 4)
        kind = "<u1" if self.chunk_bits == 8 else "<u2"
        at, self.levels = 14, []
        for _ in range(count):
            n, c, b, d = struct.unpack_from("<QIII", body, at)
            at += 20
            chunks = np.frombuffer(body, kind, n, at)
            bitmap = np.frombuffer(body, np.uint8, b, at + c)
            directory = np.frombuffer(body, "<u4", d // 4, at + c + b)
            self.levels.append((chunks, bitmap, directory))
            at += c + b + d

    def __len__(self) -> int:
        return self.length

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, at: int) -> int:
        """Set bits before bit ``at``."""
        block = at // BLOCK
        if block == len(directory):
            block -= 1
        whole = bitmap[block * (BLOCK // 8) : at // 8]
        rest = int(bitmap[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(directory[block]) + int(np.bitwise_count(whole).sum()) + rest.bit_count()

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < self.length:
            raise IndexError(at)
        value, shift = 0, 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[at]) << shift
            if not int(bitmap[at // 8]) >> (at % 8) & 1:
                break
            at = self._rank(bitmap, directory, at)
            shift += self.chunk_bits
        return value

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, exclusive; touches only their own chunks."""
        spots, out, shift = None, np.zeros(max(0, stop - start), np.uint32), 0
        for chunks, bitmap, directory in self.levels:
            if stop <= start:
                break
            part = chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if spots is None:
                out |= part
            else:
                out[spots] |= part
            low = start // 8
            bits = np.unpackbits(bitmap[low : (stop + 7) // 8], bitorder="little")[start - low * 8 : stop - low * 8].astype(bool)
            spots = np.flatnonzero(bits) if spots is None else spots[bits]
            start, stop = self._rank(bitmap, directory, start), self._rank(bitmap, directory, stop)
            shift += self.chunk_bits
        return out


def write_token_codes(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    spaces: str = "dropped",
    segment_ids: int = 1_000_000,
    chunk_bits: int = 8,
    plain_specials: bool = False,
) -> DataFrame:
    """Encode, append ``end_id`` to each document, and write segments in ascending id order.

    Returns a reader of the written segments: shard, segment, first (ids of the shard before
    it), n_ids, doc_ids, doc_tokens, payload. A segment ends with the document that takes it
    to ``segment_ids``, so a very long text is one segment. A null text is empty (just the
    end id); null ids come first; rows that repeat an id stand by text, and where texts tie,
    too, their order doesn't show. Other columns, whatever their names, are not read; an
    empty table has no segments. ``plain_specials``: strings of special tokens are ordinary
    text; otherwise they are the special tokens, as the library has it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(rows.schema["id"].dataType)),
            T.StructField("doc_tokens", T.ArrayType(T.LongType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encoder = to_arrow_schema(schema), shared_encoder(tokenizer, spaces, plain_specials)
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        ids, counts, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal segment, first, ids, counts, parts, held
            payload = encode_codes(np.frombuffer(b"".join(parts), "<u4"), chunk_bits)
            values = (shard, segment, first, held, ids, counts, payload)
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)
            segment, first = segment + 1, first + held
            ids, counts, parts, held = [], [], [], 0
            return out

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in small_batches(batch.column(1)):
                for code in encoder.encode(texts):
                    ids.append(next(names))
                    counts.append(len(code) // 4 + 1)
                    parts += (code, end)
                    held += counts[-1]
                    if held >= segment_ids:
                        yield close()
        if ids:
            yield close()

    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "body")
    return materialise(ordered.mapInArrow(write, schema), "codes")


def read_token_codes(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents read back from written segments: ``id_col``, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. Only one number a shard goes
    through the driver; a segment knows its own place in its shard.
    """
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    starts, at = [], 0
    for row in totals:
        starts.append((row["shard"], at))
        at += row["n"]
    spark = segments.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "shard int, before long"))  # one row a written shard
    id_type = segments.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for ids, counts, start, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                codes, place = DirectCodes(payload.as_py()), 0
                counts, start = counts.as_py(), start.as_py()
                begins, sums = [], []
                for n in counts:
                    begins.append(start + place)
                    sums.append(zlib.crc32(codes.read(place, place + n).astype("<u4").tobytes()))
                    place += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids.as_py(), begins, counts, sums), arrow, strict=True)], schema=arrow)

    rows = segments.join(offsets, "shard").select("doc_ids", "doc_tokens", (F.col("before") + F.col("first")).alias("start"), "payload")
    return rows.mapInArrow(read, schema).withColumnRenamed("id", id_col)
