"""Token ids of whole texts, exactly as the tokenizers library gives them, word by word.

Both kinds of vocabulary cut a text into pre-tokens before any merge, and no pre-token
crosses the cuts made here, so a piece's ids don't depend on its neighbours: the library's
model sees each distinct piece once, as long as it is remembered. Texts of plain letters,
digits, ASCII marks and single spaces are cut into pieces here; of other texts, the plain
words are, and the rest goes through the library's whole normaliser and pre-tokeniser.
Texts that hold the string of an added token are encoded whole by the library, so that
string is its token, as the library has it by default; on demand it is ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

_UNSAFE = re.compile(r"\s \s")
#: Letters that lower-case one to one and that no normal form changes.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
_PLAIN = re.compile(rf"[{_LETTER}0-9{_MARK}]+(?:\n[{_LETTER}0-9{_MARK}]+)*")
_PIECE_DROPPED = re.compile(rf"[{_LETTER}]+|[0-9]|[{_MARK}]+")
_PIECE_LEADING = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\n")
_TEXT_DROPPED = re.compile(rf"[{_LETTER}0-9{_MARK} \t\n\x0b\x0c\r]*")
_TEXT_LEADING = re.compile(rf"[{_LETTER}0-9{_MARK} \n]*")
_RUNS = ("  ", " \n", "\n ", "\n\n")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where it is visible, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class CachedEncoder:
    """``encode(texts)``: for each text its ids as little-endian unsigned 32-bit integers.

    ``spaces``: "dropped" for a lower-casing vocabulary that drops white space (words are
    cut at ASCII white space, digits stand alone), "leading" for one where a word takes the
    space before it (cut before each space that has visible text on one side; a text with
    another kind of space run is encoded whole). ``plain_specials``: strings of special
    tokens are ordinary text.
    """

    def __init__(self, path: str, spaces: str, plain_specials: bool = False, remember: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if spaces not in ("dropped", "leading"):
            raise ValueError("spaces is 'dropped' or 'leading'")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        added = [] if plain_specials else [t.content for t in self.library.get_added_tokens_decoder().values()]
        # one that is matched after lower-casing is looked for in any case
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.model = self.library.model
        self.letters = _byte_letters()
        self.leading = spaces == "leading"
        self.remember = remember
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _fill(self, pieces) -> dict[str, bytes]:
        """The remembered pieces, with these among them."""
        known = self.pieces
        new = set(pieces).difference(known)
        if len(known) + len(new) > self.remember:
            known.clear()
            new = set(pieces)
        for piece in new:
            written = piece.encode().decode("latin-1").translate(self.letters)
            known[piece] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return known

    def _join(self, pieces: list[str]) -> bytes:
        known = self._fill(pieces)
        return b"".join([known[p] for p in pieces])

    def _word(self, word: bytes) -> bytes:
        """Ids of a word as ``encode`` cuts it; a leading zero byte marks a text's first word, which has no space before it."""
        if not self.leading:
            text = word.decode()
            if not _PLAIN.fullmatch(text):
                return self._whole(text)
            return self._join(_PIECE_DROPPED.findall(text.lower()))
        first = word[:1] == b"\0"
        text = word[first:].decode()
        if not _PLAIN.fullmatch(text):
            return self._whole(text if first else " " + text)
        return self._join(_PIECE_LEADING.findall(text if first else " " + text))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, known = [], self.words
        for text in texts:
            plain = text.decode()
            if self.added and self.added.search(plain):
                out.append(self._whole(plain))
                continue
            if not self.leading:
                if _TEXT_DROPPED.fullmatch(plain):
                    out.append(self._join(_PIECE_DROPPED.findall(plain.lower())))
                    continue
                words = text.split()
            elif _TEXT_LEADING.fullmatch(plain) and not plain.endswith((" ", "\n")) and not any(r in plain for r in _RUNS):
                out.append(self._join(_PIECE_LEADING.findall(plain)))
                continue
            elif _UNSAFE.search(plain):
                out.append(self._whole(plain))
                continue
            else:
                first, *words = text.split(b" ")
                if first:
                    words.insert(0, b"\0" + first)
            new = set(words).difference(known)
            if len(new) + len(known) > self.remember // 4:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self._word(w)
            out.append(b"".join([known[w] for w in words]))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, spaces: str, plain_specials: bool = False) -> CachedEncoder:
    """One encoder a Python worker, shared by its tasks."""
    return CachedEncoder(path, spaces, plain_specials)


def small_batches(column, rows: int = 256, size: int = 4 << 20):
    """Texts of an Arrow column of bytes, null as empty, in lists of bounded size."""
    out, held = [], 0
    for value in column:
        body = value.as_py() or b""
        out.append(body)
        held += len(body)
        if len(out) == rows or held > size:
            yield out
            out, held = [], 0
    if out:
        yield out
