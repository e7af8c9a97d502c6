"""Near duplicates by SetSketch registers.

A document's set is its distinct 5-word shingles. Its sketch holds, for each of
``bands * rows`` hash functions, the smallest exponential variate over the set, floored on
a scale of powers of ``base`` and truncated: ``K = floor(1 - log_base(min))``. Registers of
two sets merge by maximum, and agree with about the probability of the sets' Jaccard
similarity. Then:

1. documents with equal sets are one class, counted before anything is compared;
2. bands of registers are bucket keys. In each bucket the smallest class is the hub, and
   every other class is a candidate of the hub only: a bucket of k classes gives k - 1
   pairs. Each class is first compared with the hub that shares most bands with it, then
   with its other hubs as far as they lie in other components;
3. buckets that still hold several components are compared exactly across components. A
   bucket of at most ``block`` classes is one task's piece of work; the classes of larger
   ones meet by shingle instead: each puts forward its rarest shingles, so many that two
   sets above the threshold must share one, and only classes that share one are compared.
   What large groups have in common is therefore never anybody's key. All pairs of those
   classes are covered by that, so a smaller bucket that consists of them is left out, and
   one that mostly does hands them its other classes;
4. candidates are estimated jointly by maximum likelihood from the three counts of
   greater, smaller and equal registers, and dropped only six standard errors below the
   threshold; the rest are confirmed on full sets;
5. components come from alternating large-star and small-star steps over written tables.

Joins on a key that may hold a large share of the rows (buckets, hubs, components) cut it
into parts first, see :func:`join_in_parts`.

With 60 bands of 5 rows a pair at similarity 0.75 shares no band with probability 7e-8, and
its estimate from 300 registers lies six standard errors (0.15) too low with probability 1e-9.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, release, spread

BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def normalise(text: bytes | None) -> bytes:
    return (text or b"").lower()  # of bytes: A-Z only


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all ``width``-word shingles; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    s = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        s = (s ^ h[k : k + n]) * _MIX
        s ^= s >> np.uint64(29)
    return np.unique(s)


class SetSketch:
    """Registers of a set of 64-bit hashes."""

    def __init__(self, registers: int, seed: int = 1) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mul = (rng.integers(0, 1 << 31, registers, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, registers, dtype=np.uint32)

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        low = np.full(len(self.mul), np.uint32(0xFFFFFFFF))
        for at in range(0, len(folded), 256):
            block = folded[at : at + 256, None] * self.mul
            block += self.add
            block ^= block >> np.uint32(15)
            block *= np.uint32(0x2C1B3C6D)
            np.minimum(low, block.min(0), out=low)
        uniform = (low.astype(np.float64) + 0.5) / 4294967296.0
        variate = -np.log1p(-uniform) / RATE
        return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likeliest_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity, row by row, of two register matrices and known set sizes."""
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    step = (BASE - 1) / BASE
    log_b = np.log(BASE)

    def p(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.maximum(1 - step * x, 1e-12)
        return np.maximum(-np.log(inner) / log_b, 1e-12), step / inner / log_b

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        mid = (low + high) / 2
        (pu, du), (pv, dv) = p(u - v * mid), p(v - u * mid)
        slope = -more * v * du / pu - less * u * dv / pv + same * (v * du + u * dv) / np.maximum(1 - pu - pv, 1e-12)
        up = slope > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def _sets(rows: DataFrame, registers: int, width: int) -> DataFrame:
    """id, n, d1, d2 (128-bit digest of the set), registers (null for an empty set)."""
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("d1", T.LongType()),
            T.StructField("d2", T.LongType()),
            T.StructField("registers", T.BinaryType()),
        ]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, hashes = SetSketch(registers), WordHashes()
        for batch in batches:
            n, d1, d2, found = [], [], [], []
            for body in batch.column(1):
                s = shingle_set(normalise(body.as_py()).split(), hashes, width)
                n.append(len(s))
                a, b = digest(s)
                d1.append(a)
                d2.append(b)
                found.append(maker.registers(s).astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(found, pa.binary())],
                names=["id", "n", "d1", "d2", "registers"],
            )

    return rows.mapInArrow(sketch, schema)


def digest(s: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(s.tobytes())
    return (whole >> 64) - (1 << 63), (whole & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def fair_share(spark, total: int) -> int:
    """Rows of one key that are too many for one task: beyond a quarter of an even share."""
    return max(256, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def join_in_parts(rows: DataFrame, groups: DataFrame, key: str, by: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, which has each ``key`` once and in ``count`` the number of its rows.

    A key with more than a fair share of the ``total`` rows is cut into parts by the hash of
    column ``by``, and its group is repeated for each part. Such keys are broadcast: there
    are at most 4 for each shuffle partition, whatever the number of rows.
    """
    share = fair_share(rows.sparkSession, total)
    large = groups.where(F.col(count) > share).select(key, F.ceil(F.col(count) / F.lit(share)).cast("int").alias("_parts"))
    cut = rows.join(F.broadcast(large), key, "left").withColumn("_part", F.pmod(F.xxhash64(F.col(by)), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    last = F.greatest(F.ceil(F.col(count) / F.lit(share)).cast("int") - 1, F.lit(0))
    repeated = groups.withColumn("_part", F.explode(F.when(F.col(count) > share, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))))
    return cut.join(repeated, [key, "_part"]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of ``edges`` (a, b) with the smallest node that it reaches, where that is another.

    Alternates large-star and small-star until nothing changes. Minima are aggregated
    before they are joined back, and a node with very many neighbours is joined in parts.
    Each half step is a written table.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (after := state(now)) != before:
        before = after
        if not after[0]:
            break
        near = both(now)
        low = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        large = join_in_parts(near, low, "u", "v", "k", 2 * after[0]).where("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = materialise(large, "edges")
        # every node now hangs under smaller ones: small-star links them to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("k"))
        small = join_in_parts(large, low, "b", "a", "k", 2 * after[0]).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
        now, old = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges"), now
        release(old, large)
    return now.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("node"), "label")


class SetCache:
    """Shingle sets of texts, made when asked for; all are dropped once ``most`` shingles are held."""

    def __init__(self, width: int, most: int = 2_000_000) -> None:
        self.width, self.most = width, most
        self.hashes, self.sets, self.held = WordHashes(), {}, 0

    def of(self, node: int, body: bytes) -> np.ndarray:
        found = self.sets.get(node)
        if found is None:
            found = shingle_set(zlib.decompress(body).split(), self.hashes, self.width)
            if self.held + len(found) > self.most:
                self.sets.clear()
                self.held = 0
            self.sets[node] = found
            self.held += len(found)
        return found


def near_pairs(own: list[np.ndarray], percent: int, slice_size: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b), a < b, of the sets that meet the threshold, by products of 0/1 matrices.

    Intersections add up over slices of the hash range, each of about ``slice_size`` shingles.
    """
    size = np.array([len(s) for s in own], np.int64)
    slices = int(size.sum()) // slice_size + 1
    exact = np.float32 if size.max(initial=0) < 1 << 24 else np.float64  # whole numbers of that size
    inter = np.zeros((len(own), len(own)), exact)
    step = max(64, (16 << 20) // (4 * len(own)))
    for k in range(slices):
        part_of = own if slices == 1 else [s[s % s.dtype.type(slices) == k] for s in own]
        _, column, times = np.unique(np.concatenate(part_of), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(own)), [len(s) for s in part_of])
        shared = times[column] > 1
        row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            low, high = np.searchsorted(column, [at, at + step])
            part = np.zeros((len(own), step), np.float32)
            part[row[low:high], column[low:high] - at] = 1
            inter += part @ part.T
    found = []
    for at in range(0, len(own), 128):  # whole numbers for a few rows at a time
        both = inter[at : at + 128].astype(np.int64)
        a, b = np.nonzero(100 * both >= percent * (size[at : at + 128, None] + size[None, :] - both))
        found.append((a + at, b))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a[a < b], b[a < b]


class NearDuplicates:
    """The steps of :func:`near_duplicates`, one method each."""

    def __init__(self, percent: int, bands: int, rows: int, width: int, block: int) -> None:
        self.percent, self.bands, self.rows, self.width, self.block = percent, bands, rows, width, block
        j = percent / 100
        self.floor = j - 6 * (j * (1 - j) / (bands * rows)) ** 0.5

    def keys(self, classes: DataFrame) -> DataFrame:
        """(key, node, n): a row for each class and band."""
        band = F.transform(
            F.sequence(F.lit(0), F.lit(self.bands - 1)),
            lambda b: F.xxhash64(b, F.substring(F.col("registers"), b * (2 * self.rows) + 1, F.lit(2 * self.rows))),
        )
        return classes.select(F.explode(band).alias("key"), "node")

    def facing(self, pairs: DataFrame, of: DataFrame) -> DataFrame:
        """(a, part, node, mine, *columns of ``of``): for each hub ``a`` its own row, ``mine``, and those of its partners.

        A hub with very many partners is cut into parts, each with the hub's row, so what
        the hub has is sent once a part, not once a pair.
        """
        pairs = materialise(pairs.select("a", "b"), "pairs")
        share = fair_share(pairs.sparkSession, pairs.count())
        counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
        large = counted.where(F.col("k") > share).select("a", F.ceil(F.col("k") / F.lit(share)).cast("int").alias("parts"))  # 4 a partition at most
        cut = pairs.join(F.broadcast(large), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
        partners = cut.select("a", "part", F.col("b").alias("node"), F.lit(False).alias("mine"))
        hubs = cut.select("a", "part").distinct().select("a", "part", F.col("a").alias("node"), F.lit(True).alias("mine"))
        rows = partners.unionByName(hubs).join(of, "node").select("a", "part", "node", "mine", *[c for c in of.columns if c != "node"])
        return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("mine"), "node")

    def likely(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) that their registers don't rule out."""
        floor, percent = self.floor, self.percent

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub = None
            for batch in batches:
                ours, theirs = [], []
                for a, node, mine, n, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                    if mine:
                        hub = (n, body)
                    elif 100 * min(n, hub[0]) >= percent * max(n, hub[0]):
                        ours.append((a, *hub))
                        theirs.append((node, n, body))
                if not ours:
                    continue
                (a, na, ra), (b, nb, rb) = zip(*ours, strict=True), zip(*theirs, strict=True)
                ra, rb = (np.frombuffer(b"".join(r), "<u2").reshape(len(r), -1) for r in (ra, rb))
                keep = likeliest_jaccard(ra, rb, np.array(na, float), np.array(nb, float)) >= floor
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep))

        return self.facing(pairs, classes.select("node", "n", "registers")).mapInArrow(estimate, "a long, b long")

    def confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs whose full sets meet the threshold."""
        width, percent = self.width, self.percent

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, left = WordHashes(), None
            for batch in batches:
                found: list[tuple[int, int]] = []
                for a, node, mine, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), batch.column(4), strict=True):
                    s = shingle_set(zlib.decompress(body.as_py()).split(), hashes, width)
                    if mine:
                        left = s
                        continue
                    shared = len(np.intersect1d(left, s, assume_unique=True))
                    if 100 * shared >= percent * (len(left) + len(s) - shared):
                        found.append((a, node))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        return self.facing(pairs, texts).mapInArrow(verify, "a long, b long")

    def rare_shingles(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """(key, node, label, lead, rest, leads): classes by the shared shingles among their rarest, where several components share one.

        ``members`` (node, label). Shingles stand by the number of members that have them,
        then by hash. The first n - ceil(percent / 100 * n) + 1 of a set of n hold one of any
        set at the threshold; those that no other member has are nobody's key. A shingle of
        more than two blocks of classes is cut into ``lead`` parts of its largest component
        (``leads``) and ``rest`` parts of all others, see :meth:`pieces`.
        """
        width, percent = self.width, self.percent

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                nodes, labels, sizes, sets = [], [], [], []
                for node, label, body in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                    s = shingle_set(zlib.decompress(body.as_py()).split(), hashes, width)
                    nodes.append(node)
                    labels.append(label)
                    sizes.append(len(s))
                    sets.append(pa.array(s.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(labels, pa.int64()), pa.array(sizes, pa.int64()), pa.array([x.to_numpy() for x in sets], pa.list_(pa.int64()))],
                    names=["node", "label", "n", "s"],
                )

        own = materialise(members.join(texts, "node").select("node", "label", "body").mapInArrow(cut, "node long, label long, n long, s array<long>"), "shingles")
        rows = own.select("node", "label", "n", F.explode("s").alias("key"))
        counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
        shared = counted.where("k > 1")
        total = own.agg(F.sum("n")).first()[0] or 0
        with_count = join_in_parts(rows, shared, "key", "node", "k", total)
        first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        per = with_count.groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("k", "key"))).alias("s"))  # a text's own shingles
        # unique ones stand first
        take = F.greatest(first - (F.col("n") - F.size("s")), F.lit(0)).cast("int")
        ahead = materialise(per.select("node", "label", F.explode(F.slice("s", F.lit(1), take)).alias("x")).select("x.key", "node", "label"), "ahead")
        by_label = ahead.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
        lists = by_label.groupBy("key").agg(F.sum("k").alias("k"), F.max(F.struct("k", "label")).alias("most")).where("k > most.k")
        return self.parted(join_in_parts(ahead, lists, "key", "node", "k", ahead.count()))

    def parted(self, listed: DataFrame) -> DataFrame:
        """(key, node, label, lead, rest, leads) from (key, node, label, k, most): k classes in all, most.k of them in component most.label."""
        whole, others = F.col("k") <= 2 * self.block, F.col("k") - F.col("most.k")
        rest = F.ceil(others / F.lit(self.block))
        lead = F.ceil(F.col("most.k") / (F.lit(2 * self.block) - F.ceil(others / rest)))
        return listed.select(
            "key",
            "node",
            "label",
            F.when(whole, 1).otherwise(lead).cast("int").alias("lead"),
            F.when(whole, 0).otherwise(rest).cast("int").alias("rest"),
            (whole | (F.col("label") == F.col("most.label"))).alias("leads"),
        )

    def pieces(self, members: DataFrame) -> DataFrame:
        """(key, i, j, node, label): each row of ``members`` (key, node, label, lead, rest, leads) in its pieces of work.

        Only classes of different components have to meet. So the parts of a key's largest
        component meet those of the others, and these meet each other, but no two parts of
        the largest: with few others, rows grow with its size, not with its square. A part's
        own classes meet in any of its pieces, which hold two blocks at most. A key without
        ``rest`` is one piece.
        """
        turn = F.xxhash64("node")
        placed = members.withColumn("mine", F.when(F.col("leads"), F.pmod(turn, F.col("lead"))).otherwise(F.col("lead") + F.pmod(turn, F.col("rest"))).cast("int"))
        last = F.col("lead") + F.col("rest") - 1
        others = (
            F.when(F.col("rest") == 0, F.array(F.lit(0)))
            .when(F.col("leads"), F.sequence(F.col("lead"), last))
            .otherwise(F.array_except(F.sequence(F.lit(0), last), F.array("mine")))
        )
        paired = placed.withColumn("other", F.explode(others))
        return paired.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "label")

    def handed_over(self, small: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(buckets that stay, classes that meet by shingle), from small buckets (key, node, label) and the classes (node, label) of large ones.

        A bucket of which at least half are such classes hands over the others. Then a bucket
        of such classes alone goes: all their pairs meet by shingle.
        """
        among = small.join(crowded.select("node", F.lit(1).alias("among")), "node", "left")
        mostly = among.groupBy("key").agg(F.count("among").alias("m"), F.count(F.lit(1)).alias("k")).where("2 * m >= k").select("key")
        crowded = materialise(crowded.union(small.join(mostly, "key", "left_semi").select("node", "label")).distinct(), "mixed")
        outside = small.join(crowded, "node", "left_anti").select("key").distinct()
        return small.join(outside, "key", "left_semi"), crowded

    def across(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """Links between components that share a key (a bucket, or a rare shingle), at most one for each two components of it.

        ``members`` (key, node, label, lead, rest, leads). A key is one piece of work, or
        several, see :meth:`pieces`. Intersections of full sets come from products of 0/1
        matrices, so no pair becomes a row.
        """
        width, percent = self.width, self.percent
        work = self.pieces(members)

        def link(rows: list[tuple[int, int, bytes]], sets: SetCache) -> list[tuple[int, int]]:
            """Links of one piece of work. Where its sets together are too large to be held, they meet in
            blocks of bounded size, by rising size of set: what is too small for all that follow meets none of it."""
            size = np.array([len(sets.of(node, body)) for node, _, body in rows], np.int64)
            label = np.unique([x for _, x, _ in rows], return_inverse=True)[1]
            order = np.argsort(size, kind="stable")
            block = np.cumsum(size[order]) // sets.most if size.sum() > sets.most else np.zeros(len(rows), np.int64)
            cut = [order[block == k] for k in np.unique(block)]
            above, out = list(range(int(label.max()) + 1)), []

            def root(x: int) -> int:
                while above[x] != x:
                    above[x] = x = above[above[x]]
                return x

            for k, mine in enumerate(cut):
                for theirs in cut[k:]:
                    if 100 * size[mine].max() < percent * size[theirs].min():
                        break
                    both = mine if theirs is mine else np.concatenate([mine, theirs])
                    a, b = near_pairs([sets.of(rows[x][0], rows[x][2]) for x in both], percent)
                    a, b = both[a], both[b]
                    apart = label[a] != label[b]
                    a, b = a[apart], b[apart]
                    _, first = np.unique(label[a] * len(above) + label[b], return_index=True)
                    for x, y in zip(a[first], b[first], strict=True):
                        p, q = root(int(label[x])), root(int(label[y]))
                        if p != q:
                            above[p] = q
                            out.append((rows[x][0], rows[y][0]))
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets, current, rows, links = SetCache(width), None, [], []
            for batch in batches:
                for key, i, j, node, label, body in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    if (key, i, j) != current:
                        if len(rows) > 1:
                            links += link(rows, sets)
                        current, rows = (key, i, j), []
                    rows.append((node, label, body))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])
                    links = []
            if len(rows) > 1:
                links += link(rows, sets)
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

        dealt = work.join(texts, "node").select("key", "i", "j", "node", "label", "body").repartition("key", "i", "j")
        return dealt.sortWithinPartitions("key", "i", "j", "node").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    bands: int = 60,
    rows: int = 5,
    width: int = 5,
    block: int = 1_024,
) -> DataFrame:
    """``id_col``, n_shingles, component_id and kept, one row for each row of ``docs``.

    A-Z are lower-cased; a document with fewer than ``width`` words has its whole sequence
    as the only shingle; a null, empty or wordless text has none and is linked with nothing.
    Documents with ``100 * |intersection| >= percent * |union|`` are linked, whole texts of
    any length, and ``component_id`` is the smallest id reachable, null where no row that is
    reached has one. ``kept`` is component_id == id; rows that repeat an id are judged each
    by its own text. Rows without an id are linked like others; where a component has no id
    at all, the rows of one of its sets are kept. Other columns, whatever their names, are
    not read; an empty table gives an empty result.
    """
    plan = NearDuplicates(percent, bands, rows, width, block)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    sketches = materialise(_sets(spread(own), bands * rows, width), "sketches")
    sets = materialise(sketches.select("id", "n", "d1", "d2"), "sets")
    classes = materialise(
        sketches.where("n > 0")
        .groupBy("d1", "d2", "n")
        .agg(F.min("id").alias("rep_id"), F.first("registers").alias("registers"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    names = materialise(classes.select("node", "d1", "d2", "n", "rep_id"), "names")
    release(sketches)

    # hubs of buckets that hold several classes
    keys = plan.keys(classes)
    hubs = materialise(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1"), "hubs")
    crowd = materialise(join_in_parts(keys, hubs, "key", "node", "k", bands * classes.count()).select("key", "node", "hub", "k"), "crowd")
    stars = materialise(
        crowd.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "stars"
    )
    release(hubs)

    # texts of the classes that stand in such buckets, once
    wanted = crowd.select("node").distinct().join(names.select("node", "rep_id", "d1", "d2"), "node")
    cut = width

    def same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that share an id, the one with the class's set."""
        hashes = WordHashes()
        for batch in batches:
            nodes, bodies = [], []
            for node, d1, d2, body in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                text = normalise(zstandard.decompress(body.as_py()))
                if digest(shingle_set(text.split(), hashes, cut)) == (d1, d2):
                    nodes.append(node)
                    bodies.append(zlib.compress(text, 1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(bodies, pa.binary())], names=["node", "body"])

    def own_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [digest(shingle_set(normalise(body.as_py()).split(), hashes, cut)) for body in batch.column(0)]
            bodies = [zlib.compress(normalise(body.as_py()), 1) for body in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(bodies, pa.binary())], names=["d1", "d2", "body"]
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts take less of the shuffle below than its own compression leaves of them."""
        pack_one = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack_one(body.as_py()) for body in batch.column(1)], pa.binary())], names=["id", "body"])

    packed = own.where("id IS NOT NULL AND body IS NOT NULL")
    named = (
        packed.mapInArrow(pack, packed.schema)
        .join(wanted, F.col("id") == F.col("rep_id"))
        .select("node", "d1", "d2", "body")
        .mapInArrow(same_set, "node long, body binary")
        .groupBy("node")
        .agg(F.first("body").alias("body"))
    )
    # classes of which no row has an id are found by their sets
    nameless = own.where("id IS NULL AND body IS NOT NULL").select("body").mapInArrow(own_set, "d1 long, d2 long, body binary").groupBy("d1", "d2").agg(F.first("body").alias("body"))
    unnamed = nameless.join(wanted.where("rep_id IS NULL").select("node", "d1", "d2"), ["d1", "d2"]).select("node", "body")
    texts = materialise(named.unionByName(unnamed), "texts")

    # each class with the hub that shares most bands with it
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    edges = materialise(plan.confirmed(plan.likely(best.select("a", "b"), classes), texts), "links")
    labels = materialise(components(edges), "labels")

    def labelled(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(node), F.col("label").alias("_l")), node, "left").withColumn(name, F.coalesce("_l", node)).drop("_l")

    # other hubs, as far as they lie in other components
    hub_labels = labelled(stars.groupBy("a").agg(F.count(F.lit(1)).alias("k")), "a", "la")
    tried = labelled(join_in_parts(stars.select("a", "b"), hub_labels, "a", "b", "k", stars.count()), "b", "lb")
    rest = tried.where("la <> lb").select("a", "b").join(best, ["a", "b"], "left_anti")
    more = materialise(plan.confirmed(plan.likely(rest, classes), texts), "links")
    if not more.isEmpty():
        edges = edges.union(more)
        labels = materialise(components(edges), "labels")

    # buckets that still hold several components, across components; a pair with the hub has been tried
    members = materialise(labelled(crowd.where("k > 2").select("key", "node", "k"), "node", "label"), "members")
    ends = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("low"), F.max("label").alias("high"))
    release(crowd, stars, classes)
    small, large = (members.where(which).select("key", "node", "label") for which in (F.col("k") <= block, F.col("k") > block))
    # a small bucket is one piece of work
    work = small.join(ends(small).where("low < high").select("key"), "key").select("key", "node", "label")
    one = (F.lit(1).alias("lead"), F.lit(0).alias("rest"), F.lit(True).alias("leads"))
    if large.isEmpty():
        work = work.select("*", *one)
    else:
        # the classes of large ones, by the rare shingles that they share
        mixed = join_in_parts(large, ends(large), "key", "node", "k", members.count()).where("low < high")
        crowded = materialise(mixed.select("node", "label").distinct(), "mixed")
        stay, crowded = plan.handed_over(materialise(work, "small"), crowded)
        work = stay.select("*", *one).unionByName(plan.rare_shingles(crowded, texts))
    open_rows = materialise(work, "mixed")
    if not open_rows.isEmpty():
        last = materialise(plan.across(open_rows, texts), "links")
        if not last.isEmpty():
            edges = edges.union(last)
            labels = materialise(components(edges), "labels")
    release(texts, members, open_rows)

    # the smallest id of each component, back to all rows
    named = labelled(names, "node", "label")
    smallest = named.groupBy("label").agg(F.min("rep_id").alias("component_id"))
    by_set = named.join(smallest, "label").select("d1", "d2", "component_id", (F.col("node") == F.col("label")).alias("leads"))
    # an empty set is nobody's: a left join on a null digest leaves it alone
    digest_of = lambda c: F.when(F.col("n") > 0, F.col(c))
    judged = sets.select("id", "n", digest_of("d1").alias("e1"), digest_of("d2").alias("e2")).join(
        by_set, (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")), "left"
    )
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return judged.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.when(F.col("id").isNull() & component.isNull(), F.coalesce("leads", F.lit(True))).otherwise(component.eqNullSafe(F.col("id"))).alias("kept"),
    )
