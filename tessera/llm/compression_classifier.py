"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled
bad. A text is cut into blocks, every block is compressed with either dictionary, and the
difference of the summed sizes, divided by the text's size, says which class it resembles.
A logistic curve over that difference and the compressed ratio, fitted on labelled rows
that the dictionaries haven't seen, makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class CompressionModel:
    good: bytes | None
    bad: bytes | None
    trained: tuple[bool, bool]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    block_bytes: int
    level: int


class _Sizer:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, model: CompressionModel) -> None:
        self.block = model.block_bytes

        def compressor(body: bytes, trained: bool) -> zstandard.ZstdCompressor:
            kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
            shared = zstandard.ZstdCompressionDict(body, dict_type=kind)
            shared.precompute_compress(level=model.level)
            return zstandard.ZstdCompressor(level=model.level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good = compressor(model.good, model.trained[0]).compress
        self.bad = compressor(model.bad, model.trained[1]).compress

    def features(self, text: bytes) -> tuple[float, float]:
        good = bad = 0
        for at in range(0, len(text) or 1, self.block):
            block = text[at : at + self.block]
            good += len(self.good(block))
            bad += len(self.bad(block))
        size = max(1, len(text))
        return (bad - good) / size, min(2.0, (bad + good) / (2 * size))


def _dictionary(blocks: list[bytes], size: int) -> tuple[bytes | None, bool]:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    if not any(blocks):
        return None, False
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(blocks)[:size], False


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised features; returns centre, scale and weights (bias last)."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, w


def fit_compression_model(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    docs_per_class: int = 3_000,
    block_bytes: int = 1_024,
    dictionary_bytes: int = 112 << 10,
    level: int = 3,
) -> CompressionModel | None:
    """Fit on a bounded sample: ``docs_per_class`` labelled rows of each class, by hash of the id.

    Half of them train the dictionaries, from all blocks of their whole texts, however long;
    the other half fits the curve. Labels other than 0 and 1, null ids and labels without a
    document are left out; an id labelled twice counts twice, and ids whose hashes tie stand
    by id. The only bound is on labelled rows. None if a class has no text.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL")
    ranked = usable.withColumn("h", F.xxhash64(F.col("id"), F.lit(17)))
    chosen = [ranked.where(F.col("y") == y).orderBy("h", "id").limit(docs_per_class) for y in (0, 1)]
    # at most 2 * docs_per_class rows of three numbers
    sample = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("id").alias("_id"), "y", "h"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")).join(sample, "_id")

    # at most docs_per_class / 2 rows of each class, with their whole texts, in one order whatever the partitions
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for row in texts.where(F.col("h") % 2 == 0).select("y", "h", "body").orderBy("y", "h", "body").toLocalIterator():
        body = bytes(row["body"])
        found[row["y"]] += [body[at : at + block_bytes] for at in range(0, len(body), block_bytes)]
    (good, good_trained), (bad, bad_trained) = _dictionary(found[1], dictionary_bytes), _dictionary(found[0], dictionary_bytes)
    if good is None or bad is None:
        return None
    model = CompressionModel(good, bad, (good_trained, bad_trained), (0.0, 0.0), (1.0, 1.0), (1.0, 0.0, 0.0), block_bytes, level)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = _Sizer(model)
        for batch in batches:
            pairs = [sizer.features(b) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64())], names=["y", "d", "r"]
            )

    seen = texts.where(F.col("h") % 2 != 0).mapInArrow(measure, "y int, d double, r double").orderBy("y", "d", "r").collect()
    if len({r["y"] for r in seen}) == 2:
        centre, scale, w = _logistic(np.array([[r["d"], r["r"]] for r in seen]), np.array([float(r["y"]) for r in seen]))
    else:  # nothing to calibrate on: the plain difference, a tenth of the size counting as 1 in the exponent
        centre, scale, w = np.zeros(2), np.array([0.1, 1.0]), np.array([1.0, 0.0, 0.0])
    return CompressionModel(good, bad, (good_trained, bad_trained), tuple(map(float, centre)), tuple(map(float, scale)), tuple(map(float, w)), block_bytes, level)


def compression_scores(
    docs: DataFrame, model: CompressionModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7
) -> DataFrame:
    """``id_col``, score (0 to 1, higher: good is likelier) and predicted (score >= ``threshold``).

    One row for each row of ``docs``, repeated and null ids included; a null text is scored
    as empty, a very long one in blocks, whole, equal texts alike, and without a model every
    score is 0.5. Other columns, whatever their names, are not read; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = _Sizer(model) if model else None
        for batch in batches:
            if sizer is None:
                out = np.full(batch.num_rows, 0.5)
            else:
                x = np.array([sizer.features(b.as_py()) for b in batch.column("body")]).reshape(-1, 2)
                z = ((x - model.centre) / model.scale) @ np.array(model.weights[:2]) + model.weights[2]
                out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out)], names=["id", "score"])

    return rows.mapInArrow(score, schema).select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
