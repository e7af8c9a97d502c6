"""Secret scan: fixed patterns, and strings that a vocabulary can't shorten.

A byte-pair vocabulary spends few tokens on words and names and many on random characters.
An unbroken string of ``least_length`` characters or more with fewer than ``least_ratio``
characters a token is reported, and so is what is left of one without the words at its
ends, and such a part of one, cut at ``/ = _ -``. Known
forms are left out: digests of the usual lengths, UUIDs, numbers, and identifiers, of which
at least half the letters and digits stand in words of the vocabulary. The run that a URL
makes is known, too; only its parts are asked.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "token")
_PATTERNS = {
    "assign": re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"(A)(KIA[A-Z0-9]+)"),
    "hex": re.compile(r"()([0-9a-f]+)"),
}
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]+")
_URL = re.compile(r"(?:://|www\.)\S+")
_CUT = re.compile(r"[^/=_-]+")
_DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_EDGES = "=-_/+"


def is_digest(s: str) -> bool:
    """A number, or hexadecimal of a usual digest's length in one case of letters."""
    return s.isdigit() or len(s) in _DIGEST_LENGTHS and bool(_HEX.fullmatch(s)) and (s.lower() == s or s.upper() == s)


class SecretScanner:
    """Spans of one text: sorted (start, kind number, end)."""

    def __init__(self, vocabulary: str, pattern: str, least_ratio: float, least_length: int) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("secret-scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.least_ratio, self.least_length = least_ratio, least_length

    def ratio(self, s: str) -> float:
        """Characters a token."""
        return len(s) / max(1, len(self.encoding.encode_ordinary(s)))

    def is_word(self, letters: str) -> bool:
        """Three letters or more that the vocabulary has as one token, in any case, or that it writes with three or more a token."""
        if len(letters) < 3:
            return False
        low = letters.lower()
        return any(form.encode() in self.ranks for form in (letters, low, " " + low, " " + low.capitalize())) or self.ratio(" " + low) >= 3

    def is_identifier(self, s: str) -> bool:
        """Words in camel case or joined by other characters: half of the letters and digits or more."""
        inside = sum(len(m[0]) for m in _LETTERS.finditer(s) if self.is_word(m[0]))
        return 2 * inside >= sum(map(str.isalnum, s)) > 0

    def suspicious(self, s: str) -> bool:
        """Long, dense, and of no known form."""
        return len(s) >= self.least_length and not is_digest(s) and self.ratio(s) < self.least_ratio and not self.is_identifier(s)

    def dense(self, text: str, links: list[tuple[int, int]], runs: Iterator[re.Match]) -> Iterator[tuple[int, int]]:
        """(start, end) of suspicious runs, or else of their suspicious parts."""
        begins = [a for a, _ in links]
        for run in runs:
            if run.end() - run.start() < self.least_length:
                continue
            # what lies between UUIDs
            at, pieces = run.start(), []
            for known in _UUID.finditer(text, run.start(), run.end()):
                pieces.append((at, known.start()))
                at = known.end()
            pieces.append((at, run.end()))
            k = bisect_right(begins, run.start()) - 1
            linked = k >= 0 and run.start() < links[k][1]
            for a, b in pieces:
                whole = text[a:b].strip(_EDGES)
                if len(whole) < self.least_length:
                    continue
                start = text.index(whole, a, b)
                parts = [(start + m.start(), start + m.end()) for m in _CUT.finditer(whole)]
                known = any(is_digest(text[x:y]) for x, y in parts if y - x >= 16)
                if not linked and not known:
                    odd = [p for p in parts if not self.is_identifier(text[p[0] : p[1]])] or parts
                    # the whole, or what is left of it without the words at either end
                    hit = next((p for p in ((start, start + len(whole)), (odd[0][0], odd[-1][1])) if self.suspicious(text[p[0] : p[1]])), None)
                    if hit:
                        yield hit
                        continue
                for x, y in parts:
                    part = text[x:y].strip(_EDGES)
                    if (len(parts) > 1 or linked) and self.suspicious(part):
                        x = text.index(part, x, y)
                        yield x, x + len(part)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        # no pattern spans white space but assign's, whose value doesn't
        longest = max(map(len, text.split()), default=0)
        found: list[tuple[int, int, int]] = []

        def base(kind: str, least: int, whole: bool) -> None:
            for m in _PATTERNS[kind].finditer(text):
                if (m.end() - m.start() if whole else len(m[2])) >= least:
                    found.append((m.start(), KINDS.index(kind), m.end()))

        if longest >= 12:
            low = text.lower()
            if any(k in low for k in _KEYWORDS):
                base("assign", 12, False)
        if longest >= 18 and "AKIA" in text:
            base("access", 18, True)
        if longest >= 16 and re.search(r"[0-9a-f]{16}", text):
            base("hex", 16, True)
        if longest >= self.least_length:
            taken = sorted((a, b) for a, _, b in found)
            begins, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
            links = [m.span() for m in _URL.finditer(text)] if "://" in text or "www." in text else []
            for a, b in self.dense(text, links, _RUN.finditer(text)):
                k = bisect_right(begins, a) - 1
                if k < 0 or ends[k] < b:  # not inside a base span
                    found.append((a, KINDS.index("token"), b))
        return sorted(found)


def scan_secrets(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_ratio: float = 2.0,
    least_length: int = 20,
) -> DataFrame:
    """``id_col`` and spans, an array of (kind, start, end), one row for each row of ``docs``.

    Positions count code points, end exclusive; spans stand by start, then by kind in the
    order assign, access, hex, token, and where both tie, by end. A token span that lies in
    one base span is not added; one that only overlaps is. ``least_ratio`` and
    ``least_length`` decide what the token rule asks and reports. A null or empty text has no
    span; very long texts are scanned whole, in time that grows with their length; repeated
    rows and null ids are scanned like others. Other columns, whatever their names, are not
    read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(span))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, scanner = to_arrow_schema(schema), SecretScanner(vocabulary, pattern, least_ratio, least_length)
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(body.as_py())] for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, arrow.field("spans").type)], schema=arrow)

    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """``text`` with its spans, overlapping ones merged, replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
