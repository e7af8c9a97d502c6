"""Markdown as rich-text JSON: a document's lines become flat block rows, and the rows are put together from the leaves up.

Headings, paragraphs with their line breaks, fenced code, rules, quotes, tables, and nested
lists; in a line code, links, bold and addresses. Underscores and single asterisks are left as
they are: they are names and globs more often than emphasis.

With ``written`` the nodes also keep how their marks were written and every blank line is an
empty paragraph, so :func:`markdown_lines` gives a document's lines back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trees import nested_json

# How each kind of line and of inline mark is written.
FENCE = re.compile(r"\s*(?:```|~~~)\s*([A-Za-z0-9+#._-]*)\s*")
RULE = re.compile(r"\s*([-*_])\s*(?:\1\s*){2,}")
HEADING = re.compile(r"(#{1,6})\s+(.*)")
QUOTE = re.compile(r"\s*>\s?(.*)")
ITEM = re.compile(r"(\s*)(?:[-*+]|(\d+[.)]))\s+(.*)")
DELIMITER = re.compile(r"\s*\|?(?:\s*:?-{2,}:?\s*\|)+\s*:?-{2,}:?\s*\|?\s*")
LANGUAGE = re.compile(r"[a-z0-9+#-]+")
INLINE = re.compile(r"`([^`\n]+)`|\[([^\]\n]*)\]\(([^)\s]+)\)|\*\*([^*\n]+)\*\*|(https?://[^\s<>)\]]+)")

#: What is trimmed from written lines.
SPACE = " \t\v\f\r"

SCHEMA = "tree {tree}, id long, parent long, depth long, rank long, head string, tail string"


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def inline(text: str, written: bool = False) -> list[dict]:
    """A line's text nodes."""
    out, at = [], 0
    for m in INLINE.finditer(text):
        code, label, target, strong, address = m.groups()
        mark = {"type": "code"} if code else {"type": "strong"} if strong else {"type": "link", "attrs": {"href": target or address} | ({"written": label} if written and target else {})}
        out += [(text[at : m.start()], None), (code or strong or address or label or target, mark)]
        at = m.end()
    out.append((text[at:], None))
    return [{"type": "text", "text": t} | ({"marks": [mark]} if mark else {}) for t, mark in out if t]


class _Rows:
    """One document's block rows; ``open`` gives a node whose children come later, ``leaf`` one that is whole."""

    def __init__(self, written: bool = False) -> None:
        self.rows: list[tuple] = []
        self.written = written

    def attrs(self, attrs: dict | None, written) -> dict | None:
        """``attrs`` with the marks as they were written, where those are kept."""
        return (attrs or {}) | {"written": written} if self.written and written is not None else attrs

    def open(self, parent: tuple[int, int] | None, kind: str, attrs: dict | None = None, written=None, **more) -> tuple[int, int]:
        attrs = self.attrs(attrs, written)
        fields = {"type": kind} | more | ({"attrs": attrs} if attrs is not None else {})
        node = (len(self.rows), 0 if parent is None else parent[1] + 1)
        self.rows.append((node[0], None if parent is None else parent[0], node[1], node[0], dumps(fields)[:-1] + ',"content":[', "]}"))
        return node

    def leaf(self, parent: tuple[int, int], kind: str, content: list[dict] | None = None, attrs: dict | None = None, written=None) -> None:
        attrs = self.attrs(attrs, written)
        fields = {"type": kind} | ({"attrs": attrs} if attrs is not None else {}) | ({"content": content} if content is not None else {})
        self.rows.append((len(self.rows), parent[0], parent[1] + 1, len(self.rows), dumps(fields), ""))

    def paragraph(self, parent: tuple[int, int], lines: list[str]) -> None:
        content = [node for k, line in enumerate(lines) for node in ([{"type": "hardBreak"}] if k else []) + inline(line, self.written)]
        self.leaf(parent, "paragraph", content)


def spans(line: str) -> list[tuple[int, int]]:
    """Where the cells of a table's line begin and end, without the space around them."""
    bare = line.strip()
    at = line.index(bare) + len(bare) - len(bare.lstrip("|"))
    out = []
    for cell in bare.strip("|").split("|"):
        begin = at + len(cell) - len(cell.lstrip())
        out.append((begin, begin + len(cell.strip())))
        at += len(cell) + 1
    return out


def kind_of(line: str, following: str | None) -> tuple[str, re.Match | None]:
    if not line.strip():
        return "blank", None
    for kind, form in (("fence", FENCE), ("rule", RULE), ("heading", HEADING), ("quote", QUOTE)):
        if m := form.fullmatch(line):
            return kind, m
    if "|" in line and following is not None and DELIMITER.fullmatch(following):
        return "table", None
    m = ITEM.fullmatch(line)
    return ("item", m) if m else ("text", None)


def fill(rows: _Rows, into: tuple[int, int], lines: list[str]) -> None:
    """The blocks of ``lines`` as children of ``into``."""
    lists: list[list] = []  # open lists: indent, numbered, node, last item
    run, held, before, k = "", [], [], 0  # the kind of the lines that are being gathered, and what stood before those of a quote

    def flush() -> None:
        nonlocal run, held, before
        if run == "text":
            rows.paragraph(into, [line if rows.written else line.strip() for line in held])
        elif run == "quote":
            below = rows.open(into, "blockquote", written=before)
            empty = len(rows.rows)
            fill(rows, below, held)
            if len(rows.rows) == empty:
                rows.paragraph(below, [])
        run, held, before = "", [], []

    while k < len(lines):
        kind, m = kind_of(lines[k], lines[k + 1] if k + 1 < len(lines) else None)
        if kind != run:
            flush()
        if kind != "item":
            lists.clear()
        if kind in ("text", "quote"):
            run = kind
            held.append(m[1] if m else lines[k])
            before.append(lines[k][: m.start(1)] if m else "")
        elif kind == "blank" and rows.written:
            rows.paragraph(into, [lines[k]])
        elif kind == "heading":
            rows.leaf(into, "heading", inline(m[2] if rows.written else m[2].strip(), rows.written), {"level": len(m[1])}, lines[k][: m.start(2)])
        elif kind == "rule":
            rows.leaf(into, "rule", written=lines[k])
        elif kind == "fence":
            end = next((j for j in range(k + 1, len(lines)) if FENCE.fullmatch(lines[j])), len(lines))
            body, language = "\n".join(lines[k + 1 : end]), m[1].lower()
            some = end > k + 1 if rows.written else body
            rows.leaf(into, "codeBlock", [{"type": "text", "text": body}] if some else None, {"language": language} if LANGUAGE.fullmatch(language) else None, [lines[k], *lines[end : end + 1]])
            k = end
        elif kind == "table":
            cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
            end = next((j for j in range(k + 2, len(lines)) if not lines[j].strip() or "|" not in lines[j]), len(lines))
            width, table = len(cells(lines[k])), rows.open(into, "table", {"isNumberColumnEnabled": False, "layout": "default"}, lines[k + 1])
            for j in (k, *range(k + 2, end)):
                cut = [0, *(at for span in spans(lines[j])[:width] for at in span), len(lines[j])]
                row = rows.open(table, "tableRow", written=[lines[j][a:b] for a, b in zip(cut[::2], cut[1::2])])  # what stands around its cells
                for text in (cells(lines[j]) + [""] * width)[:width]:
                    rows.paragraph(rows.open(row, "tableHeader" if j == k else "tableCell", {}), [text])
            k = end - 1
        elif kind == "item":
            indent, numbered, below = len(m[1]), m[2] is not None, False
            while lists and indent < lists[-1][0]:
                below = bool(lists.pop())
            while lists and lists[-1][1] != numbered and indent <= lists[-1][0]:
                lists.pop()  # the other kind of list begins
            if not lists or (indent > lists[-1][0] and not below):
                parent = lists[-1][3] if lists else into
                lists.append([indent, numbered, rows.open(parent, "orderedList" if numbered else "bulletList"), None])
            lists[-1][3] = rows.open(lists[-1][2], "listItem", written=lines[k][: m.start(3)])
            rows.paragraph(lists[-1][3], [m[3]])
        k += 1
    flush()


def block_rows(text: str | None, written: bool = False) -> list[tuple]:
    """(id, parent, depth, rank, head, tail) of a document's blocks; one without any has an empty paragraph."""
    rows = _Rows(written)
    root = rows.open(None, "doc", version=1)
    fill(rows, root, (text or "" if written else re.sub(r"\r\n?", "\n", text or "")).split("\n"))
    if len(rows.rows) == 1:
        rows.paragraph(root, [])
    return rows.rows


def _source(node: dict) -> str:
    """A text node as it was written."""
    if node["type"] == "hardBreak":
        return "\n"
    text = node["text"]
    for mark in node.get("marks", ()):
        attrs = mark.get("attrs", {})
        text = f"`{text}`" if mark["type"] == "code" else f"**{text}**" if mark["type"] == "strong" else f"[{attrs['written']}]({attrs['href']})" if "written" in attrs else text
    return text


def markdown_lines(node: dict) -> list[str]:
    """The lines of a node made with ``written``, up to the space around them."""
    kind, content, written = node["type"], node.get("content") or [], node.get("attrs", {}).get("written")
    if kind == "paragraph":
        return "".join(map(_source, content)).split("\n")
    if kind == "heading":
        return [written + "".join(map(_source, content))]
    if kind == "rule":
        return [written]
    if kind == "codeBlock":
        return written[:1] + (content[0]["text"].split("\n") if content else []) + written[1:]
    if kind == "tableRow":
        cells = [line for cell in content for line in markdown_lines(cell)]
        return [written[0] + "".join(cell + after for cell, after in zip(cells, written[1:]))]
    below = [line for x in content for line in markdown_lines(x)]
    if kind == "table":
        return [below[0], written, *below[1:]]
    if kind == "blockquote":
        return [mark + line for mark, line in zip(written, below, strict=True)]
    return [written + below[0], *below[1:]] if kind == "listItem" else below


def markdown_blocks(docs: DataFrame, written: bool = False) -> DataFrame:
    """Flat block rows (tree, id, parent, depth, rank, head, tail) of ``docs`` (tree, text)."""

    def run(frames) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 500):
                part = f.iloc[k : k + 500]
                rows = [(tree, *row) for tree, text in zip(part["tree"], part["text"]) for row in block_rows(text, written)]
                out = pd.DataFrame(rows, columns=["tree", "id", "parent", "depth", "rank", "head", "tail"])
                yield out.astype({"parent": "Int64"})

    return docs.select("tree", "text").mapInPandas(run, SCHEMA.format(tree=docs.schema["tree"].dataType.simpleString()))


def markdown_json(docs: DataFrame, written: bool = False) -> DataFrame:
    """(tree, json) of ``docs`` (tree, text): every document as rich text; null and empty texts are an empty paragraph."""
    return nested_json(markdown_blocks(docs, written))
