import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.token_counts import PieceCounter, token_counts

from .fixtures import frame, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
alphabet = st.sampled_from(["a", " ", "the", "ing", "\n", "漢", "字", "é", "😀", "12", "<s>", "</s>", "<unk>", "▁", "\0", "aaaa", "Qz", "    ", "x", "́"])


@pytest.fixture(scope="module")
def small():
    return PieceCounter(MODEL, chunk=24, overlap=4)


def whole(counter, text):
    return len(counter.library.encode(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(alphabet, max_size=60).map("".join))
def test_chunks_splice_to_the_whole(small, text):
    assert small.count([text]) == [whole(small, text)]


def test_widening(small):
    """No boundary in a run of one letter is stable, so overlaps grow until the run ends."""
    before = small.widened
    text = "some words " + "a" * 500 + " and more 漢字 words " + " " * 90 + "end " * 40
    assert small.count([text]) == [whole(small, text)]
    assert small.widened > before


def test_stable_boundaries_cut_the_encoding(small):
    """What is proven holds: at a stable boundary the tokens of the two halves are those of the whole."""
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["ab", " ", "the ", "漢", "9", "zq", "\n", "é"]) for _ in range(20))
        begins = small._begins(text, 0, len(text))
        for at in range(1, len(text)):
            if small.stable(text, at):
                assert at in begins
                assert small._begins(text, 0, at) == [b for b in begins if b < at]


def test_operator(spark):
    rows = [(1, "plain words"), (2, None), (3, ""), (None, "no id"), (4, "tie"), (4, "tie"), (5, words(1, 60_000)), (6, "漢" * 5000), (7, "<s> x </s>")]
    got = sorted(map(tuple, token_counts(frame(spark, rows), MODEL, chunk=1 << 12).collect()), key=str)
    library = PieceCounter(MODEL).library
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in rows]
    assert got == sorted(want, key=str)
    assert [r[3] for r in got if r[0] in (5, 6)] == [True, True]


def test_other_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "plain <|endoftext|> words"), (2, None)]
    got = {r.doc_id: r.n_tokens for r in token_counts(frame(spark, rows), path).collect()}
    assert got == {1: len(Tokenizer.from_file(path).encode("plain <|endoftext|> words", add_special_tokens=False).ids), 2: 0}


def test_empty(spark):
    assert token_counts(frame(spark, []), MODEL).count() == 0
