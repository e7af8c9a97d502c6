import random

import numpy as np
import pytest

from tessera.llm import near_dedup as N

from .fixtures import frame, words


def brute(rows, percent=75):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                above[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(s), least[root(k)]) for k, (i, s) in enumerate(sets)}


def mutate(text, rnd, edits):
    w = text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rnd = random.Random(5)
    rows, passage = [], words(99, 60, "p")
    for g in range(12):
        base = words(g, rnd.choice([8, 40, 200]))
        rows += [mutate(base, rnd, rnd.choice([0, 1, 2, 4])) for _ in range(6)]
    rows += [passage + " " + words(1000 + k, rnd.choice([5, 12, 20])) for k in range(60)]  # many share most of a text
    hot = words(7, 150)
    rows += [mutate(hot, rnd, rnd.choice([1, 3, 5, 6])) for _ in range(80)]  # a chain of near copies
    rows += ["", None, " \n", "one", "ONE", "two words", "a b c d e", words(3, 6_000), mutate(words(3, 6_000), rnd, 100)]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(k * 3, rows[o]) for k, o in enumerate(order)]


@pytest.mark.parametrize("block", [1_024, 7])
def test_components_against_brute_force(spark, block):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame(spark, rows).repartition(3), block=block).collect()}
    assert got == brute(rows)


def test_repeated_and_null_ids(spark):
    base = words(1, 60)
    rows = [(1, base), (1, base), (2, base.upper()), (None, base), (None, "alone here"), (5, None), (5, None)]
    out = N.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in out} == {(1, 1, True), (2, 1, False), (None, 1, False), (None, None, True), (5, 5, True)}


@pytest.mark.parametrize("block", [1_024, 5])
def test_rows_without_ids_are_linked(spark, block):
    """Brute force over rows of which every third has no id."""
    rows = [(None if k % 3 == 0 else k + 1, t) for k, (_, t) in enumerate(corpus())]
    sets = brute([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            c = sets[k][1]
            least[c] = min(least.get(c, i), i)
    want = [(str(i), sets[k][0], least.get(sets[k][1])) for k, (i, _) in enumerate(rows)]
    out = N.near_duplicates(frame(spark, rows).repartition(3), block=block).collect()
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in out), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.component_id is not None)


def test_groups_without_any_id_keep_one_set(spark):
    base = words(4, 80).split()
    a, b = " ".join(base), " ".join([*base[:-1], "other"])
    out = N.near_duplicates(frame(spark, [(None, a), (None, b), (None, b), (3, "else here")])).collect()
    kept = {r.n_shingles: r.kept for r in out if r.doc_id is None}
    assert len(out) == 4 and sum(r.kept for r in out if r.doc_id is None) in (1, 2) and kept


def test_large_buckets_meet_by_rare_shingles(spark):
    """Texts that share two thirds and link with nobody, but for a few near copies among them."""
    rnd, shared = random.Random(2), words(50, 80, "s")
    rows = [(k, shared + " " + words(2_000 + k, 40, f"u{k}x")) for k in range(150)]
    rows += [(500 + k, mutate(rows[k * 7][1], rnd, 2)) for k in range(9)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame(spark, rows), block=16).collect()}
    assert got == brute(rows)


def test_pieces_grow_with_a_component_not_with_its_square(spark):
    """All classes of different components meet; one large component among few others costs rows in proportion."""
    plan, block = N.NearDuplicates(75, 60, 5, 5, 16), 16

    def pieces(sizes):
        rows, node = [], 0
        for label, size in enumerate(sizes):
            rows += [(1, node + x, label, sum(sizes), (max(sizes), sizes.index(max(sizes)))) for x in range(size)]
            node += size
        listed = spark.createDataFrame(rows, "key long, node long, label long, k long, most struct<k: long, label: long>")
        held = {}
        for r in plan.pieces(plan.parted(listed)).collect():
            held.setdefault((r.i, r.j), []).append((r.node, r.label))
        met = {(a, b) for piece in held.values() for a, x in piece for b, y in piece if x != y}
        label = {r[1]: r[2] for r in rows}
        assert met == {(a, b) for a in label for b in label if label[a] != label[b]}
        assert max(len(piece) for piece in held.values()) <= 3 * block  # two, but for the unevenness of hashes
        return sum(len(piece) for piece in held.values())

    assert pieces([20, 5, 7]) == 32
    assert pieces([200] + [1] * 10) <= 2 * 210
    assert pieces([400] + [1] * 10) <= 2 * 410  # by blocks of all classes against each other: 410 * 26
    pieces([1] * 90)
    pieces([60, 50, 3])


def test_buckets_of_classes_that_meet_by_shingle_are_left_out(spark):
    plan = N.NearDuplicates(75, 60, 5, 5, 16)
    buckets = {1: range(0, 10), 2: range(5, 14), 3: range(8, 16), 4: [9, 30, 31, 32], 5: [12, 13, 2], 6: [30, 31]}
    small = spark.createDataFrame([(k, n, n % 3) for k, nodes in buckets.items() for n in nodes], "key long, node long, label long")
    crowded = spark.createDataFrame([(n, n % 3) for n in range(10)], "node long, label long")
    stay, crowded = plan.handed_over(small, crowded)
    assert sorted((r.node, r.label) for r in crowded.collect()) == [(n, n % 3) for n in range(14)]
    assert sorted((r.key, r.node) for r in stay.collect()) == [(k, n) for k in (3, 4, 6) for n in buckets[k]]


def test_large_keys_are_joined_in_parts(spark):
    rows = spark.range(5_000).selectExpr("if(id < 4000, 1, id) AS key", "id AS node")
    groups = rows.groupBy("key").count().selectExpr("key", "count AS k", "key * 10 AS value")
    got = N.join_in_parts(rows, groups, "key", "node", "k", 5_000)
    assert sorted((r.key, r.node, r.value) for r in got.collect()) == sorted((r.key, r.node, r.key * 10) for r in rows.collect())


def test_empty(spark):
    assert N.near_duplicates(frame(spark, [])).count() == 0


def test_registers_merge_and_estimate():
    rng, sketch = np.random.default_rng(3), N.SetSketch(2_000)
    x = rng.integers(0, 1 << 63, 3_000, dtype=np.uint64)
    a, b = x[:2_000], x[500:]
    ra, rb = sketch.registers(a), sketch.registers(b)
    assert (N.merge_registers(ra, rb) == sketch.registers(x)).all()
    found = N.likeliest_jaccard(ra[None], rb[None], np.array([2_000.0]), np.array([2_500.0]))[0]
    assert abs(found - 0.5) < 0.05


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.label for r in N.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    above = {}
    root = lambda x: x if above.setdefault(x, x) == x else root(above[x])
    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(above) if root(x) != x}


def test_large_sets_meet_in_bounded_blocks():
    """Sets that can't be held together are compared by blocks and slices, with the same pairs."""
    import numpy as np

    from tessera.llm.near_dedup import SetCache, near_pairs

    rnd = np.random.default_rng(9)
    base = [rnd.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(4)]
    own = [np.unique(np.where(rnd.random(400) < 0.1, rnd.integers(0, 1 << 63, 400).astype(np.uint64), base[k % 4])) for k in range(24)]
    want = {(a, b) for a in range(24) for b in range(a + 1, 24) if 100 * len(np.intersect1d(own[a], own[b])) >= 75 * len(np.union1d(own[a], own[b]))}
    assert want
    for slice_size in (10**6, 500, 50):
        assert set(zip(*map(np.ndarray.tolist, near_pairs(own, 75, slice_size)))) == want
    import zlib

    cache = SetCache(5, most=300)
    texts = [zlib.compress(" ".join(f"w{j}" for j in range(k, k + 104)).encode()) for k in range(9)]
    for k in (0, 1, 2, 0, 8, 1):
        assert len(cache.of(k, texts[k])) == 100
        assert cache.held == sum(map(len, cache.sets.values())) <= 300
