"""Best-fit packing by bin completion with branch and bound.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the search
runs on the table of counts by length: its size doesn't follow the corpus. Around the
largest length still open, the undominated fillings of the rest of its sequence are
enumerated, lazily; one is chosen, and repeated as often as the counts allow, or less often.
Best-fit decreasing gives the first incumbent; a branch whose waste can no longer beat the
incumbent is pruned by the lower bound of what is left. The search ends at the lower bound,
when nothing is left to try, or, as a fallback, after a fixed number of steps: then the
branch at hand is finished by best fit. No piece is ever lost by that, only sequences may
be more than the fewest.

The plan is a short list of runs: so many sequences with this filling. Documents find their
place in it by their rank among those of equal length, which is counted in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, spread
from .tokens import encoder as shared_encoder
from .tokens import small_batches

Run = tuple[tuple[int, ...], int]  # lengths of a sequence, and how many sequences have them


def reachable(counts: list[int], top: int, room: int) -> dict[int, int]:
    """For each length up to ``top`` that is left: a bitmap of the sums, up to ``room``, of pieces no longer than it."""
    sums, mask, out = 1, (1 << (room + 1)) - 1, {}
    for size in range(1, min(top, room) + 1):
        n, step = min(counts[size], room // size), 1
        if not n:
            continue
        while n > 0:  # 1, 2, 4, ... copies give every number of copies up to n
            k = min(step, n)
            sums |= sums << (k * size) & mask
            n, step = n - k, step * 2
        out[size] = sums
    return out


class Patience:
    """Steps that a search may still take: ``left`` in all, ``each`` for one filling."""

    def __init__(self, left: int, each: int) -> None:
        self.left, self.each, self.spent = left, each, 0

    def step(self) -> bool:
        self.left -= 1
        self.spent += 1
        return self.left > 0 and self.spent <= self.each


def fillings(counts: list[int], room: int, patience: Patience | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of every undominated filling of ``room``, lazily: least waste first, then longest pieces first.

    A filling is dominated if some of its pieces could be exchanged for one longer piece
    that is left (or several for one as long as all of them) without overflowing: what the
    exchange frees is at least as easy to place. Sums that can't be reached are never
    entered, so all work leads to fillings or to their dominance. The enumeration is whole
    unless ``patience`` ends it.
    """
    sums = reachable(counts, room, room)
    sizes = sorted(sums, reverse=True)
    whole = sums[sizes[0]] if sizes else 1
    has = sum(1 << s for s in sizes)

    def beaten(one: int, several: int, waste: int) -> int:
        """Lengths that would take the place of some pieces, or of none."""
        out, more = several, one | 1
        for _ in range(waste):
            more <<= 1
            out |= more
        return out

    def visit(at: int, left: int, waste: int, chosen: tuple[int, ...], one: int, several: int, free: int) -> Iterator[tuple[int, ...]]:
        """``one``, ``several``: sums of some of ``chosen``, of two or more; ``free``: lengths that stay over above the last piece."""
        if not left:
            if not beaten(one, several, waste) & free:
                yield chosen
            return
        for k in range(at, len(sizes)):
            size = sizes[k]
            used = chosen.count(size) if chosen and chosen[-1] == size else 0
            if patience and not patience.step():
                return
            if size > left or not sums[size] >> left & 1 or used >= counts[size]:
                continue
            # pieces above this length are all chosen: what is left of them may dominate
            over = free & -(1 << (size + 1))
            two, any_sum = several | one << size, one | one << size | 1 << size
            if not beaten(any_sum, two, waste) & over:
                yield from visit(k, left - size, waste, (*chosen, size), any_sum, two, free & ~(1 << size) if used + 1 == counts[size] else free)

    for waste in range(room + 1):
        if whole >> (room - waste) & 1:
            yield from ((waste, f) for f in visit(0, room - waste, waste, (), 0, 0, has))


def _times(counts: list[int], filling: tuple[int, ...]) -> int:
    return min(counts[size] // filling.count(size) for size in set(filling))


def best_fit(counts: list[int], capacity: int) -> list[Run]:
    """Best-fit decreasing on counts: the largest length, then always the largest that fits."""
    counts, runs = list(counts), []
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            filling, space = [largest], capacity - largest
            for size in range(min(space, largest), 0, -1):
                n = min(space // size, counts[size] - filling.count(size))
                if n > 0:
                    filling += [size] * n
                    space -= n * size
            n = _times(counts, tuple(filling))
            for size in filling:
                counts[size] -= n
            runs.append((tuple(filling), n))
    return runs


def least_sequences(counts: list[int], capacity: int) -> int:
    """A lower bound: pieces that can't share a sequence with one of length a or more, for every a."""
    number = np.array(counts, np.int64)
    n, size = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(number * np.arange(len(number)))])
    half = capacity // 2
    a = np.arange(1, half + 1)
    alone = n[capacity + 1] - n[capacity - a + 1]
    big, big_size = n[capacity - a + 1] - n[half + 1], size[capacity - a + 1] - size[half + 1]
    small = size[half + 1] - size[a]
    with_small = alone + big + np.maximum(0, -(-(small - (big * capacity - big_size)) // capacity))
    return max(-(-int(size[-1]) // capacity), int(with_small.max(initial=0)))


def evened(found: Iterator[tuple[int, tuple[int, ...]]], most: int = 1_000) -> Iterator[tuple[int, tuple[int, ...]]]:
    """The same fillings; of neighbours with equal waste, up to ``most``, those whose longest piece is shortest come first."""
    for _, same in groupby(found, key=lambda x: x[0]):
        while part := list(islice(same, most)):
            yield from sorted(part, key=lambda x: max(x[1], default=0))


def plan_sequences(counts: list[int], capacity: int, steps: int = 12_000_000, steps_each: int = 20_000, steps_a_sequence: int = 400_000) -> list[Run]:
    """Runs that place ``counts[length]`` pieces of each length, in as few sequences as two searches find.

    The first tries long pieces first, the second even fillings first, the one with a third
    of ``steps``, the other with the rest; best fit is the first incumbent. A search that meets the lower bound is the last, and
    one that is a few sequences above it may take ``steps_a_sequence`` for each of them only.
    """
    best, bound = best_fit(counts, capacity), least_sequences(counts, capacity)
    for even, share in ((False, steps // 3), (True, steps - steps // 3)):
        above = sum(n for _, n in best) - bound
        best = bin_completion(counts, capacity, best, even, min(share, above * steps_a_sequence), steps_each)
    return best


def bin_completion(counts: list[int], capacity: int, incumbent: list[Run], even: bool, steps: int, steps_each: int) -> list[Run]:
    """A plan of fewer sequences than ``incumbent``, or ``incumbent``.

    Depth first. A node takes the largest length left and one of its undominated fillings,
    as often as the counts allow; on the way back once less often, down to once, and then
    the next filling. ``even``: of up to 1,000 fillings of equal waste, those whose longest
    piece is shortest come first; otherwise long pieces come first, and fillings of one
    length are taken in that order only. A node is left when the sequences it has used and
    the lower bound of what is left can't beat the incumbent. Without the two limits the
    search is whole. Where ``steps_each`` steps find no filling, the node takes the best-fit one;
    after ``steps`` the current branch is finished by best fit and the best plan returned.
    """
    bound, best = least_sequences(counts, capacity), incumbent
    fewest = sum(n for _, n in best)
    patience = Patience(steps, steps_each)
    state, used = list(counts), 0
    path: list[list] = []  # length, its fillings still to come, waste and filling now, how often

    def put(filling: tuple[int, ...], n: int) -> None:
        nonlocal used
        used += n
        for size in filling:
            state[size] -= n

    def options(largest: int, after: tuple | None) -> Iterator[tuple[int, tuple[int, ...]]]:
        rest = list(state)
        rest[largest] -= 1
        patience.left -= capacity
        room = capacity - largest
        none = True
        found = fillings(rest, room, patience)
        for waste, f in evened(found) if even else found:
            if after is None or (waste, tuple(-v for v in f)) > after:
                none, patience.spent = False, 0
                yield waste, (largest, *f)
        if none and patience.spent > patience.each:
            patience.spent = 0
            f, left = [], room
            for size in range(room, 0, -1):
                n = min(left // size, rest[size])
                f += [size] * n
                left -= n * size
            yield left, (largest, *f)

    def advance() -> bool:
        """The last node's next choice; nodes without one are left."""
        while path:
            node = path[-1]
            if node[3]:
                put(node[2][1], -node[3])
            if node[3] > 1:
                node[3] -= 1
            else:
                patience.spent = 0
                node[2] = next(node[1], None)
                if node[2] is None:
                    path.pop()
                    continue
                node[3] = _times(state, node[2][1])
            put(node[2][1], node[3])
            return True
        return False

    going = True
    while going and fewest > bound:
        if patience.left <= 0:
            rest = best_fit(state, capacity)
            if used + sum(n for _, n in rest) < fewest:
                best = [(node[2][1], node[3]) for node in path] + rest
            break
        largest = next((k for k in range(capacity, 0, -1) if state[k]), 0)
        if not largest and used < fewest:
            best, fewest = [(node[2][1], node[3]) for node in path], used
        elif largest and used + least_sequences(state, capacity) < fewest:
            before = path[-1] if not even and path and path[-1][0] == largest else None
            after = (before[2][0], tuple(-v for v in before[2][1][1:])) if before else None
            path.append([largest, options(largest, after), None, 0])
        going = advance()
    return best


def _slots(runs: list[Run], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of each slot run, its first sequence, and the place in a sequence."""
    out: dict[int, list[list[int]]] = {}
    ranks, sequence = [0] * (capacity + 1), 0
    for filling, n in runs:
        offset = 0
        for size in filling:
            cell = out.setdefault(size, [[], [], []])
            for col, v in zip(cell, (ranks[size], sequence, offset), strict=True):
                col.append(v)
            ranks[size] += n
            offset += size
        sequence += n
    return {size: tuple(np.array(c, np.int64) for c in cells) for size, cells in out.items()}


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 1_024,
    id_col: str = "doc_id",
    text_col: str = "text",
    spaces: str = "leading",
    with_ids: bool = False,
    plain_specials: bool = False,
) -> DataFrame:
    """Tokenise, append ``end_id``, cut what is longer than ``capacity``, and pack.

    One row a piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset, and
    ``ids`` (little-endian unsigned 32-bit) if ``with_ids``. Only longer documents are cut:
    into pieces of ``capacity`` ids, the first one taking what is over; very long texts are
    encoded whole and give many pieces. A null or empty text packs its end id alone; rows
    that repeat an id are documents of their own, and so are those with a null id.
    Pieces of equal length are placed in the order of the input's tasks. Other columns,
    whatever their names, are not read; an empty table has no pieces. Sequences are
    numbered from 0 and filled without gaps. ``plain_specials``: strings of special tokens
    are ordinary text; otherwise they are the special tokens, as the library has it.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")))
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("task", T.IntegerType()),
            T.StructField("among", T.LongType()),
            *([T.StructField("ids", T.BinaryType())] if with_ids else []),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encoder = to_arrow_schema(schema), shared_encoder(tokenizer, spaces, plain_specials)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in small_batches(batch.column(1)):
                cols: list[list] = [[] for _ in arrow]
                for code in encoder.encode(texts):
                    name, code = next(names), code + end
                    n = len(code) // 4
                    stop, at, piece = (n - 1) % capacity + 1, 0, 0
                    while at < n:
                        part = code[4 * at : 4 * stop]
                        values = [name, piece, at, stop - at, zlib.crc32(part), task, seen[stop - at]]
                        for col, v in zip(cols, values + [part] * with_ids, strict=True):
                            col.append(v)
                        seen[stop - at] += 1
                        at, stop, piece = stop, stop + capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    pieces = materialise(rows.mapInArrow(cut, schema), "pieces")
    # how many pieces of each length earlier tasks have
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "task", "before")

    counts = [0] * (capacity + 1)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        counts[row["length"]] = row["n"]
    slots = _slots(plan_sequences(counts, capacity), capacity)

    placed_schema = T.StructType(
        [f for f in schema if f.name not in ("task", "among")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(placed_schema)
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                first, begins, places = slots[int(size)]
                run = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = begins[run] + rank[mine] - first[run], places[run]
            kept = [batch.column(f.name) for f in arrow if f.name not in ("sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=arrow)

    found = pieces.join(ranked, ["length", "task"]).withColumn("rank", F.col("before") + F.col("among")).drop("before", "among", "task")
    return found.mapInArrow(place, placed_schema).withColumnRenamed("id", id_col)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """Rows of :func:`pack_documents` with ids, put together: sequence_id, length, ids."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return (
        pieces.groupBy("sequence_id")
        .agg(ordered.alias("p"))
        .select(
            "sequence_id",
            F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
            F.aggregate("p", F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"])).alias("ids"),
        )
    )
