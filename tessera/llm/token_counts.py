"""Exact token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced.

A boundary between two characters is *proven stable* if no piece of the vocabulary holds the
two side by side: then no merge can ever cross it, so the tokens on either side don't depend
on the other side, and both chunks that see it agree on it. Chunks of a huge text overlap;
they are spliced at a proven boundary within the overlap where a token begins in both, and
each chunk counts the tokens from its left splice to its right one. Where an overlap holds no
such boundary it is doubled, in the end to the rest of the text, which is then one chunk. So
a count is always the library's own for the whole text, and memory is bounded by a chunk
unless a text has no stable boundary for longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread
from .tokens import small_batches

#: How SentencePiece writes a space.
SPACE = "▁"


class PieceCounter:
    """Counts with a SentencePiece model, without begin, end or added special tokens.

    ``chunk``: characters of a chunk; longer texts are huge. ``overlap``: characters that
    neighbours share at first. ``widened`` counts the overlaps that had to grow.
    """

    def __init__(self, path: str, chunk: int = 1 << 16, overlap: int = 256) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model_pb2.ModelProto.SentencePiece
        self.pairs, self.known, self.bytes = set(), set(), model.trainer_spec.byte_fallback
        for piece in model.pieces:
            if piece.type not in (kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN):
                self.known.update(piece.piece)
                self.pairs.update(map("".join, zip(piece.piece, piece.piece[1:])))
        norm = model.normalizer_spec
        # a normaliser that rewrites texts, or puts the space mark behind words, leaves no offsets to splice at
        self.plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.chunk, self.overlap, self.widened = chunk, overlap, 0

    def stable(self, text: str, at: int) -> bool:
        """No piece spans the boundary before ``text[at]``, and no run of unknown characters does."""
        pair = text[at - 1 : at + 1].replace(" ", SPACE)
        return pair not in self.pairs and (self.bytes or not self.known.isdisjoint(pair))

    def _begins(self, text: str, start: int, end: int) -> list[int]:
        """Where in ``text`` each token of this chunk begins, in ascending order."""
        part = text[start:end]
        at, out, chars = 0, [], 0
        body = part.encode()
        for token in self.library.encode(part, return_type="proto").pieces:
            chars += len(body[at : token.begin].decode())
            at = token.begin
            out.append(start + chars)
        return out

    def _splice(self, text: str, left: list[int], right: list[int], start: int, end: int) -> int | None:
        """The first stable boundary strictly inside (start, end) where a token begins in both chunks."""
        common = set(left).intersection(right)
        return next((at for at in range(start + 1, end) if at in common and self.stable(text, at)), None)

    def count_huge(self, text: str) -> int:
        chunk = self.chunk
        total, taken, start, end = 0, 0, 0, min(chunk, len(text))
        begins = self._begins(text, start, end)
        while end < len(text):
            overlap = min(self.overlap, chunk // 2)
            while True:
                later = max(end - overlap, taken)
                later_end = min(later + max(chunk, 2 * overlap), len(text))
                following = self._begins(text, later, later_end)
                cut = self._splice(text, begins, following, later, end)
                if cut is not None:
                    break
                self.widened += 1
                overlap *= 2
                end = min(end + overlap, len(text))
                begins = self._begins(text, start, end)
                if end == len(text):
                    break
            if cut is None:
                break
            total += sum(taken <= at < cut for at in begins)
            taken, start, end, begins = cut, later, later_end, following
        return total + sum(at >= taken for at in begins)

    def count(self, texts: list[str]) -> list[int]:
        huge = [self.plain and len(t) > self.chunk for t in texts]
        short = iter(self.library.encode([t for t, h in zip(texts, huge) if not h], num_threads=1))
        return [self.count_huge(t) if h else len(next(short)) for t, h in zip(texts, huge)]


class LibraryCounter:
    """Counts with a ``tokenizers`` file: whole texts, without truncation or padding."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> PieceCounter | LibraryCounter:
    """One counter a Python worker, shared by its tasks."""
    return PieceCounter(path, chunk, overlap) if path.endswith(".model") else LibraryCounter(path)


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 1 << 16,
    overlap: int = 256,
) -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``): a row a document.

    ``tokenizer``: a SentencePiece ``.model``, or a ``tokenizers`` ``.json`` (whose texts are
    encoded whole). A null text is empty and has no tokens; very long texts are counted in
    overlapping chunks, exactly. Null and repeated ids, and rows that tie, are counted row by
    row; other columns, whatever their names, are not read; an empty table gives no rows. One
    scan, no shuffle but for a table of fewer row groups than cores.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, tokens = to_arrow_schema(schema), counter(tokenizer, chunk, overlap)
        for batch in batches:
            sizes, counts = [], []
            for texts in small_batches(batch.column(1)):
                sizes += map(len, texts)
                counts += tokens.count([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=arrow)

    counted = spread(rows).mapInArrow(run, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
