"""Embedding whitening by a randomised range finder and Rayleigh-Ritz.

The covariance V is never formed to begin with. A block of random directions, some more
than the components asked for, is multiplied by V in one pass over all centred rows, made
orthonormal, and multiplied again (power passes). The product of a pass gives the
Rayleigh-Ritz pairs of its block and their residuals without another pass. If the residuals
don't fall fast enough to reach double precision, the block is expanded to the full
dimension, where one pass gives all pairs exactly. A last pass measures how far the
covariance of the whitened rows is from the identity.

Vectors are put on a whole-number grid first, so sums and centring are exact. What a task
holds and what reaches the driver is bounded by the square of the dimension, never by rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: The grid: an entry c is the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of larger size have no exact place on the grid.
LARGEST = float(1 << 62)
#: Components with less than this share of the first one's variance are noise.
RANK = 1e-11


@dataclass(frozen=True)
class Whitening:
    """A fitted model: ``n`` rows, exact ``sums`` a dimension, unit ``components`` (columns) by falling ``variances``,
    the share of all variance that each explains, and how it was found."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int
    expanded: bool

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return _centre(self.n, self.sums)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and the rest, below one."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's entries begin, how many it has, and all entries; -1 entries for a row that is null, or holds nulls, non-finite or too large ones."""
    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    offsets = column.offsets.to_numpy()
    entries = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        good = np.isfinite(entries) & (np.abs(entries * SCALE) < LARGEST)
    bad = np.concatenate([[0], np.cumsum(~good)])
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    return offsets[:-1], np.where(usable, np.diff(offsets), -1), entries


def _grid(begins: np.ndarray, entries: np.ndarray, d: int) -> np.ndarray:
    return np.floor(SCALE * entries[begins[:, None] + np.arange(d)]).astype(np.int64) + SHIFT


def _blocks(column: pa.Array, d: int, entries: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and grid vectors of the usable rows of dimension ``d``, in blocks of bounded size."""
    begins, lengths, values = _lists(column)
    rows = np.flatnonzero(lengths == d)
    step = max(1, entries // max(d, 1))
    for k in range(0, len(rows), step):
        part = rows[k : k + step]
        yield part, _grid(begins[part], values, d)


def _total(x: np.ndarray) -> list[int]:
    """Exact sums by column."""
    small = x.size == 0 or int(np.abs(x).max()) < (1 << 62) // len(x)
    return [int(v) for v in (x if small else x.astype(object)).sum(axis=0)]


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """The dimension that most usable vectors have (the larger of two), their number, and their sums by dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            lengths = _lists(batch.column(0))[1]
            for d in map(int, np.unique(lengths[lengths >= 0])):
                for rows, x in _blocks(batch.column(0), d):
                    count[d] = count.get(d, 0) + len(rows)
                    sums[d] = [a + b for a, b in zip(sums.get(d, [0] * d), _total(x), strict=True)]
        out = [(d, -1, str(n)) for d, n in count.items()] + [(d, j, str(s)) for d, of in sums.items() for j, s in enumerate(of)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], names=["d", "j", "s"])

    parts = vectors.mapInArrow(part, "d int, j int, s string")
    sums = materialise(parts.groupBy("d", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "sums")
    first = sums.where("j = -1").orderBy(F.desc("s"), F.desc("d")).limit(1).collect()
    if not first:
        return 0, 0, []
    d = first[0]["d"]
    return d, int(first[0]["s"]), [int(r["s"]) for r in sums.where((F.col("d") == d) & (F.col("j") >= 0)).orderBy("j").collect()]


def _pass(vectors: DataFrame, d: int, n: int, sums: list[int], right: np.ndarray, product: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``product(centred rows, right)``, a matrix whose size doesn't depend on the rows.

    Each task sends its own sum, a row a line of the matrix; lines are added up by their
    number, and only the sum reaches the driver.
    """
    held = vectors.sparkSession.sparkContext.broadcast((right, *_centre(n, sums)))  # bounded by the dimension's square

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, whole, rest = held.value
        total = None
        for batch in batches:
            for _, x in _blocks(batch.column(0), d):
                made = product((x - whole) - rest, directions)
                total = made if total is None else total + made
        if total is not None:
            yield lines(dict(enumerate(total)))

    def lines(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        values = pa.array([v.tobytes() for v in found.values()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), values], names=["i", "line"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[i] = found.get(i, 0.0) + np.frombuffer(line.as_py())
        if found:
            yield lines(found)

    schema = "i int, line binary"
    rows = vectors.mapInArrow(part, schema).repartition("i").mapInArrow(add, schema).orderBy("i").collect()
    held.unpersist()
    return np.array([np.frombuffer(r["line"]) for r in rows])


def _ritz(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz pairs of V on an orthonormal block, given V @ block, by falling value, with their residuals."""
    small = block.T @ image
    values, turns = np.linalg.eigh((small + small.T) / 2)
    values, turns = values[::-1], turns[:, ::-1]
    found = block @ turns
    return values, found, np.linalg.norm(image @ turns - found * values, axis=0)


def fit_whitening(
    df: DataFrame, vector_col: str = "embedding", components: int = 32, oversampling: int = 10, power_passes: int = 6, tolerance: float = 1e-14, seed: int = 7
) -> Whitening:
    """Fit on all usable rows of ``df``.

    ``tolerance``: largest residual of a component, as a share of the largest variance;
    ``power_passes``: most passes before the block is expanded to the full dimension, which
    is done sooner where the residuals' fall says that they won't get there. Rows whose
    vector is null, or holds nulls, non-finite entries or ones beyond the grid (2**62 / 64),
    or hasn't the dimension that most rows have, are left out. No rows, or rows that are all
    equal, give a model without components; so do directions without variance. Repeated rows
    count as often as they stand there; other columns, whatever their names, are not read.
    """
    vectors = df.select(F.col(vector_col).alias("v"))
    d, n, sums = _sums(vectors)
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0, 1, False)
    k = min(components, d)
    width = min(d, k + oversampling)

    def image_of(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
        """V's part in the directions; one line more for the trace."""
        return np.vstack([x.T @ (x @ directions), np.full((1, directions.shape[1]), np.square(x).sum())])

    block = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    passes, worst = 1, None
    while True:
        image = _pass(vectors, d, n, sums, block, image_of) / n
        image, trace = image[:-1], image[-1, 0]
        values, found, residuals = _ritz(block, image)
        passes += 1
        before, worst = worst, residuals[:k].max()
        goal, full = tolerance * values[0], block.shape[1] == d
        if full or worst <= goal:
            break
        left = power_passes - (passes - 1)
        if left <= 0 or (before is not None and worst * (worst / before) ** left > goal):
            block = np.eye(d)
        else:
            block = np.linalg.qr(image)[0]
    kept = int(np.sum(values[:k] > RANK * values[0])) if values[0] > 0 else 0
    found, values = found[:, :kept], values[:kept]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(kept)]) if kept else np.zeros(0)
    found = found * signs
    error = 0.0
    if kept:
        weights = found / np.sqrt(values)

        def moments(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
            w = x @ directions
            return np.vstack([w.T @ w, w.sum(axis=0)])

        seen = _pass(vectors, d, n, sums, weights, moments) / n
        error = float(np.abs(seen[:-1] - np.outer(seen[-1], seen[-1]) - np.eye(kept)).max())
        passes += 1
    explained = values / trace if kept else values
    return Whitening(n, sums, found, values, explained, error, passes, bool(full and width < d))


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, deviation and whitened (an entry a component) of each row that the model can take.

    ``deviation``: the sum over dimensions of (n * x - sum)**2, exact; null where no long
    holds it. Rows that can't be used (see :func:`fit_whitening`) are left out; null and
    repeated ids are rows like others; a model without components gives empty arrays.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    d, n = len(model.sums), model.n
    if not n:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    whole, rest = model.centre
    off = [s - n * int(w) for s, w in zip(model.sums, whole, strict=True)]
    weights = model.components / np.sqrt(model.variances)
    held = rows.sparkSession.sparkContext.broadcast((whole, rest, off, weights))  # bounded by the dimension's square

    def deviations(y: np.ndarray, off: list[int]) -> list[int | None]:
        reach = n * int(np.abs(y).max(initial=0)) + max(map(abs, off), default=0)
        if d * reach**2 < 1 << 63:
            return list(np.square(n * y - np.array(off, np.int64)).sum(axis=1))
        exact = [sum((n * int(v) - o) ** 2 for v, o in zip(row, off, strict=True)) for row in y]
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        whole, rest, off, weights = held.value
        for batch in batches:
            for part, x in _blocks(batch.column(1), d):
                y = x - whole
                white = (y - rest) @ weights
                flat = pa.array(white.ravel(), pa.float64())
                bounds = pa.array(np.arange(len(part) + 1, dtype=np.int32) * white.shape[1])
                ids = batch.column(0).take(pa.array(part)).cast(arrow.field(0).type)
                lists = pa.ListArray.from_arrays(bounds, flat).cast(arrow.field(2).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(y, off), pa.int64()), lists], schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
