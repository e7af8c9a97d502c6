"""Exact duplicates by Patricia-trie owners.

Two passes over the texts, both linear:

1. every input partition inserts its texts into compressed radix tries, one subtree for
   each (length class, content-hash slice), so copies inside a partition shrink to one
   terminal before anything is shuffled. When a task holds more than ``memory_bytes`` of
   text, its largest subtree is handed downstream and forgotten (spill by subtree, through
   Spark's own writer, so nothing stays on a local disk);
2. terminals meet in partitions by (length, content hash), sorted, and are inserted whole
   into their partition's trie. What stands in it is complete as soon as its key has
   passed, so when the trie holds more than ``memory_bytes``, all of its subtrees but the
   current key's are handed on and forgotten. A task holds that much and one key's texts.

A group of copies therefore sends at most one row per input task, however many documents
it has. Members join their owner by terminal, not by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise


class PatriciaTrie:
    """A compressed radix trie over byte strings.

    A node is ``[label, children, value]``: ``children`` maps a first byte to a node, and
    ``value`` is set where a string ends.
    """

    __slots__ = ("root", "strings", "held")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.strings = 0
        self.held = 0

    def slot(self, key: bytes) -> list:
        """The node where ``key`` ends, made if need be."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                return node
            child = node[1].get(key[at])
            if child is None:
                leaf = [key[at:], {}, None]
                node[1][key[at]] = leaf
                self.held += len(key) - at
                return leaf
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _shared(label, key[at : at + len(label)])
            fork = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][key[at]] = fork
            node, at = fork, at + shared

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            whole = prefix + node[0]
            if node[2] is not None:
                yield whole, node[2]
            stack.extend((whole, child) for child in node[1].values())


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _better(a, b, largest: bool) -> bool:
    """Whether id ``a`` owns a group before ``b``; null owns last."""
    if a is None or b is None:
        return a is not None
    return a > b if largest else a < b


def exact_owners(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: str = "smallest",
    memory_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per input row: its id, the id that stays for its text, and the group's size.

    ``owner``: "smallest" or "largest" id stays. Texts are compared after lower-casing A-Z
    only. A null text counts as empty, and empty texts are one group. A null id never owns
    a group that has another id. Where rows repeat, ids included, ``kept`` is true for
    exactly one row of a group. Other columns of ``docs``, whatever their names, are not
    read. Very long texts are compared whole, and one is held at a time beyond
    ``memory_bytes``. An empty table gives an empty result.

    Returns ``id_col``, keep_id, group_size, kept, text_sha256.
    """
    if owner not in ("smallest", "largest"):
        raise ValueError("owner is 'smallest' or 'largest'")
    largest = owner == "largest"
    id_type = docs.schema[id_col].dataType
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
    )

    partial_schema = T.StructType(
        [
            T.StructField("terminal", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("content_hash", T.LongType()),
            T.StructField("body", T.BinaryType()),
            T.StructField("owner", id_type),
            T.StructField("copies", T.LongType()),
            T.StructField("members", T.ArrayType(id_type)),
        ]
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(partial_schema)
        first = TaskContext.get().partitionId() << 36
        made = 0
        forest: dict[tuple[int, int], PatriciaTrie] = {}
        held = 0

        def spill(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
            nonlocal made
            cols: list[list] = [[] for _ in arrow]
            size = 0
            for body, (best, members, digest) in trie.terminals():
                at = members.index(best)
                members[0], members[at] = members[at], members[0]
                for col, v in zip(cols, (first + made, len(body), digest, body, best, len(members), members), strict=True):
                    col.append(v)
                made += 1
                size += len(body)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
                    cols, size = [[] for _ in arrow], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, raw in zip(ids, batch.column(1), strict=True):
                body = raw.as_py().lower()  # of bytes: A-Z only
                digest = xxhash.xxh3_64_intdigest(body)
                trie = forest.setdefault((len(body).bit_length(), digest & 15), PatriciaTrie())
                before = trie.held
                node = trie.slot(body)
                if node[2] is None:
                    node[2] = [i, [i], digest - (1 << 63)]
                else:
                    node[2][1].append(i)
                    if _better(i, node[2][0], largest):
                        node[2][0] = i
                held += trie.held - before + 16
                trie.held += 16
                while held > memory_bytes and forest:
                    key = max(forest, key=lambda k: forest[k].held)
                    gone = forest.pop(key)
                    held -= gone.held
                    yield from spill(gone)
        for key in list(forest):
            yield from spill(forest.pop(key))

    terminals = materialise(rows.mapInArrow(partial, partial_schema), "terminals")

    merged_schema = T.StructType(
        [
            T.StructField("terminal", T.LongType()),
            T.StructField("keep_id", id_type),
            T.StructField("group_size", T.LongType()),
            T.StructField("owns", T.BooleanType()),
            T.StructField("text_sha256", T.StringType()),
        ]
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(merged_schema)
        cols: list[list] = [[] for _ in arrow]

        def close(trie: PatriciaTrie) -> None:
            for body, (best, total, owning, terminals_here) in trie.terminals():
                digest = hashlib.sha256(body).hexdigest()
                for t in terminals_here:
                    for col, v in zip(cols, (t, best, total, t == owning, digest), strict=True):
                        col.append(v)

        def batch_out() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            for c in cols:
                c.clear()
            return out

        current, trie = None, PatriciaTrie()
        for batch in batches:
            lengths, hashes, bodies, owners, copies, names = (batch.column(k) for k in range(6))
            for length, digest, body, best, n, t in zip(lengths.to_pylist(), hashes.to_pylist(), bodies, owners.to_pylist(), copies.to_pylist(), names.to_pylist(), strict=True):
                if (length, digest) != current:
                    current = (length, digest)
                    if trie.held > memory_bytes or trie.strings >= 10_000:
                        close(trie)
                        trie = PatriciaTrie()
                        yield batch_out()
                node = trie.slot(body.as_py())
                if node[2] is None:
                    trie.strings += 1
                    node[2] = [best, n, t, [t]]
                    continue
                have = node[2]
                have[1] += n
                have[3].append(t)
                if _better(best, have[0], largest) or best == have[0] and t < have[2]:
                    have[0], have[2] = best, t
        close(trie)
        if cols[0]:
            yield batch_out()

    owners = (
        terminals.select("length", "content_hash", "body", "owner", "copies", "terminal")
        .repartition("length", "content_hash")
        .sortWithinPartitions("length", "content_hash")
        .mapInArrow(merge, merged_schema)
    )
    return (
        terminals.select("terminal", "members")
        .join(owners, "terminal")
        .select("keep_id", "group_size", "owns", "text_sha256", F.posexplode("members").alias("place", "member"))
        .select(
            F.col("member").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("owns") & (F.col("place") == 0)).alias("kept"),
            "text_sha256",
        )
    )
