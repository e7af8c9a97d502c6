"""Cached encoding, directly addressable codes, packing."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.direct_codes import DirectCodes, encode_codes, read_token_codes, write_token_codes
from tessera.llm.packing import best_fit, fillings, least_sequences, pack_documents, packed_sequences, plan_sequences
from tessera.llm.tokens import encoder

from .fixtures import frame, words

VOCABULARIES = [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")]
bits = st.sampled_from(["<|startoftext|>", "<|ENDOFTEXT|>", "a", "B", "é", "È", "0", "12", "\n", ".\n", " ", " ", "  ", "\t", "'s", "'", "́", "\xa0", "!!", "Σ", "ς", "<|endoftext|>", "\x1c", "ß", "中", "😀", "_", "İ", "ª", "\r\n"])
TEXTS = [(5, "Hello there,\nWorld"), (3, None), (3, ""), (1, "x"), (None, "no id"), (9, words(1, 3_000)), (2, "a  b\n\n c"), (6, "end <|endoftext|> here"), (4, "É" * 2_000), (7, "tie"), (7, "tie"), (8, words(2, 1_500))]


def library(name, plain=None):
    """The library as it loads, unless ``plain`` says how it takes special strings."""
    t = Tokenizer.from_file(public_tokenizers.path(name))
    if plain is not None:
        t.encode_special_tokens = plain
    return t


@pytest.mark.parametrize("name,spaces", VOCABULARIES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(bits, max_size=25).map("".join), min_size=1, max_size=8), plain=st.booleans())
def test_ids_equal_the_library(name, spaces, texts, plain):
    got = encoder(public_tokenizers.path(name), spaces, plain).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library(name, plain or None).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,spaces", VOCABULARIES)
def test_special_strings_are_what_the_library_makes_of_them(name, spaces):
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "x  <|endoftext|>\n"]
    got = encoder(public_tokenizers.path(name), spaces).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library(name).encode(t, add_special_tokens=False).ids for t in texts]
    assert len(got[0]) == 4 * len(library(name).encode("a <|endoftext|> b", add_special_tokens=False).ids) <= 16


@pytest.mark.parametrize("chunk", [8, 16])
@given(values=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=1_300), data=st.data())
@settings(max_examples=60, deadline=None)
def test_random_access(chunk, values, data):
    codes = DirectCodes(encode_codes(np.array(values, np.uint32), chunk))
    assert len(codes) == len(values)
    low = data.draw(st.integers(0, len(values)))
    high = data.draw(st.integers(low, len(values)))
    assert codes.read(low, high).tolist() == values[low:high]
    assert [codes[i] for i in range(low, min(high, low + 20))] == values[low : min(high, low + 20)]
    with pytest.raises(IndexError):
        codes[len(values)]


@pytest.mark.parametrize("segment", [1_000_000, 40])
def test_codes_read_back(spark, segment):
    docs = frame(spark, TEXTS).repartition(3)
    segments = write_token_codes(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, segment_ids=segment)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_codes(segments).orderBy("start").collect()]
    t, want, at = library("word_bpe_49k.json"), [], 0
    for i, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_codes_of_nothing(spark):
    segments = write_token_codes(frame(spark, []), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert segments.count() == 0 and read_token_codes(segments).count() == 0


def test_packing_round_trip(spark):
    docs = frame(spark, TEXTS + [(100 + k, words(k, 40 + 13 * k)) for k in range(60)]).repartition(4)
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, with_ids=True).cache()
    t, want = library("byte_bpe_50k.json"), []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1_024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1_024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    rows = pieces.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    counts = [0] * 1_025
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
            counts[length] += 1
        assert at <= 1_024
    assert len(by_sequence) <= least_sequences(counts, 1_024) + 1
    for s in packed_sequences(pieces).collect():
        assert bytes(s.ids) == b"".join(x[2] for x in sorted(by_sequence[s.sequence_id]))


def test_packing_nothing(spark):
    assert pack_documents(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"), end_id=2).count() == 0


def optimum(items, capacity):
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins)}.values():
            if bins[b] + items[k] <= capacity:
                bins[b] += items[k]
                go(k + 1, bins)
                bins[b] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=9))
def test_plans_are_whole_and_optimal_on_small_cases(items):
    counts = [0] * 16
    for x in items:
        counts[x] += 1
    runs, placed = plan_sequences(counts, 15), [0] * 16
    for filling, n in runs:
        assert sum(filling) <= 15
        for x in filling:
            placed[x] += n
    assert placed == counts
    assert least_sequences(counts, 15) <= sum(n for _, n in runs) == optimum(sorted(items, reverse=True), 15)


def undominated(counts, room):
    """By enumeration: fillings of which no pieces, or none, can be exchanged for one longer piece that is left, or several for one as long."""
    items = [s for s, n in enumerate(counts) for _ in range(n)]
    every = {tuple(sorted((items[i] for i in c), reverse=True)) for k in range(len(items) + 1) for c in itertools.combinations(range(len(items)), k)}
    out = []
    for f in (f for f in every if sum(f) <= room):
        left, waste = list(counts), room - sum(f)
        for s in f:
            left[s] -= 1
        parts = [c for k in range(len(f) + 1) for c in itertools.combinations(f, k)]
        if not any(left[x] and (sum(c) < x <= sum(c) + waste or x == sum(c) and len(c) > 1) for c in parts for x in range(1, len(counts))):
            out.append((waste, tuple(-v for v in f)))
    return sorted(out)


@settings(max_examples=120, deadline=None)
@given(st.integers(3, 13), st.lists(st.integers(1, 13), max_size=8))
def test_fillings_are_all_undominated_ones_in_order(room, items):
    counts = [0] * (room + 1)
    for x in items:
        counts[min(x, room)] += 1
    assert [(w, tuple(-v for v in f)) for w, f in fillings(counts, room)] == undominated(counts, room)


def test_perfect_triples_are_within_three_per_cent():
    rnd, counts = random.Random(3), [0] * 1_025
    for _ in range(600):
        a, b = rnd.randint(260, 420), rnd.randint(260, 420)
        for x in (a, b, 1_024 - a - b):
            counts[x] += 1
    found = sum(n for _, n in plan_sequences(counts, 1_024))
    assert 600 <= found <= 618 < sum(n for _, n in best_fit(counts, 1_024))


def test_a_search_without_steps_is_best_fit():
    counts = [0, 5, 3, 0, 2, 7, 1, 0, 0]
    assert sum(n for _, n in plan_sequences(counts, 8, steps=0)) == sum(n for _, n in best_fit(counts, 8))
