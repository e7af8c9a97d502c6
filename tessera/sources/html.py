"""HTML as plain text with Markdown headings and code marks, so that sections and mentions are found in it like in Markdown."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is no prose, elements that stand on lines of their own, and those that hold code in a line.
SILENT = ("script", "style", "noscript", "template", "svg")
LINES = "p div section article header footer aside main nav ul ol li table tr td th br hr pre blockquote dl dt dd figcaption".split()
CODE = ("code", "tt", "kbd", "samp", "var")
#: What is written where an element begins and where it ends.
MARKS = {t: ("\n", "\n") for t in LINES} | {f"h{n}": (f"\n{'#' * n} ", "\n") for n in range(1, 7)} | {t: (" `", "` ") for t in CODE}


class _Fold(HTMLParser):
    """The state is how many silent and preformatted elements are open; an end without a beginning closes nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open, self.parts = Counter(), []

    def mark(self, tag: str, side: int) -> None:
        if tag in MARKS and not (tag in CODE and self.open["pre"]):  # a whole sample isn't a name
            self.parts.append(MARKS[tag][side])

    def handle_starttag(self, tag, attrs) -> None:
        kind = "silent" if tag in SILENT else tag
        self.open[kind] += kind in ("silent", "pre")
        self.mark(tag, 0)

    def handle_endtag(self, tag) -> None:
        self.mark(tag, 1)
        kind = "silent" if tag in SILENT else tag
        self.open[kind] -= self.open[kind] > 0

    def handle_data(self, data) -> None:
        words = data.split()
        if words and not self.open["silent"]:
            self.parts.append(" ".join(words) + " ")


def prose(html: str | None) -> str | None:
    """The text of a page; null where there is none."""
    if html is None:
        return None
    fold = _Fold()
    fold.feed(html)
    fold.close()
    # code marks close around what they hold, and go where they hold nothing
    whole = re.sub(r"`\s*([^`\n]*?)\s*`", lambda m: f"`{m[1]}`" if m[1] else "", "".join(fold.parts))
    lines = [re.sub(r"[ \t]+", " ", line).strip() for line in whole.splitlines()]
    kept = [line for k, line in enumerate(lines) if line or (k and lines[k - 1])]
    return "\n".join(kept).strip() or None


def html_text(html: Column) -> Column:
    """:func:`prose` over Arrow batches: pages are independent, and a page is one row's work."""
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(prose)

    return run(html)
