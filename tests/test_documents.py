"""Trees, memories, components, pages, Markdown, HTML, contracts and paged sources against brute force on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import contracts, markdown
from tessera.operators import phrases, traversal, trees
from tessera.operators.memory import consolidate
from tessera.sources.html import prose
from tessera.sources.paged import PagedReader, read_pages, save_pages

NODES = "tree long, id long, parent long, rank long, text string"


def preorder(rows):
    """(id, place, depth) by recursion."""
    out = []

    def visit(parent, depth):
        for _, i in sorted((r, i) for i, p, r in rows if p == parent):
            out.append((i, len(out), depth))
            visit(i, depth + 1)

    visit(None, 0)
    return out


def test_reading_order_of_random_forests(spark):
    rnd, rows, want = random.Random(3), [], {}
    for tree in range(6):
        mine = [(k, None if rnd.random() < 0.1 else rnd.randrange(k) if k else None, rnd.randrange(3)) for k in range(rnd.choice([1, 5, 40]))]
        want |= {(tree, i): (place, depth) for i, place, depth in preorder(mine)}
        rows += [(tree, *m, f"t{m[0]}") for m in mine]
    rows += [(9, k, k - 1 if k else None, 0, f"c{k}") for k in range(70)]  # a chain
    want |= {(9, k): (k, k) for k in range(70)}
    rows += [(8, 1, 2, 0, "a"), (8, 2, 1, 0, "b"), (8, 3, 77, 0, "c"), (8, 4, 3, 0, "d"), (8, 5, None, 0, "root")]  # a cycle, and below a node that isn't there
    want |= {(8, 5): (0, 0)} | {(8, k): (None, None) for k in (1, 2, 3, 4)}
    got = {(r.tree, r.id): (r.place, r.depth) for r in trees.reading_order(spark.createDataFrame(rows, NODES)).collect()}
    assert got == want
    texts = {r.tree: (r.text, r.blocks, r.deepest) for r in trees.flat_text(spark.createDataFrame(rows, NODES)).collect()}
    assert texts[9] == ("\n".join(f"c{k}" for k in range(70)), 70, 69) and texts[8] == ("root", 1, 0)


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 160)] + [(3, 3)]
    ids = sorted({x for e in links for x in e} | {999})
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = traversal.components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == label


def test_consolidation_by_brute_force(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(14)]
    rows = [(k, rnd.choice(["r", "s"]), rnd.choice(["x", "y"]), sorted(set(rnd.sample(words, rnd.choice([0, 2, 3, 4, 5])))) if k % 9 else None) for k in range(90)]
    old = [(*r, [0.1, 0.3, 0.5][r[0] // 3 % 3], r[0]) for r in rows if r[0] % 3 == 0]
    new = [r for r in rows if r[0] % 3]
    memories, want = {r[0]: [r[1], r[2], set(r[3] or ()), r[4], r[5]] for r in old}, {}
    for pk, repo, kind, tokens in new:
        tokens = set(tokens or ())
        if not tokens:
            want[pk] = ("skipped", None)
            continue
        scored = [(len(tokens & m[2]) / len(tokens | m[2]), -k) for k, m in memories.items() if m[:2] == [repo, kind] and m[2]]
        score, k = max(scored, default=(0, 0))
        if score >= 0.6:
            memories[-k][3], memories[-k][4] = min(0.99, memories[-k][3] + 0.1), None
            want[pk] = ("reinforced", -k)
        else:
            memories[pk] = [repo, kind, tokens, 0.5, None]
            want[pk] = ("inserted", pk)
    for k, m in memories.items():
        if k % 3 == 0:
            stale = m[4] is not None and m[4] < 40
            want[k] = ("kept" if not stale else "decayed" if round(m[3] - 0.05, 9) >= 0.15 else "deleted", k)
    schema = "pk long, repo string, kind string, tokens array<string>"
    got = consolidate(spark.createDataFrame(old, schema + ", confidence double, touched long"), spark.createDataFrame(new, schema), fresh_since=40)
    assert {r.pk: (r.verdict, r.memory) for r in got.collect()} == want
    assert {v for v, _ in want.values()} == {"inserted", "reinforced", "skipped", "kept", "decayed", "deleted"}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, None),
        ("", None),
        ("<h2>A  b</h2><p>one<p>two<br>three", "## A b\n\none\ntwo\nthree"),
        ("x <code> Invoice </code> y <tt></tt>z", "x `Invoice` y z"),
        ("<pre>a <code>b</code></pre>c", "a b\nc"),
        ("<script>var a='<p>'</script>a<style>b</style><svg><g>c</g></svg>d", "a d"),
        ("</script>a<noscript>b<template>c</template>d</noscript>e</svg>f", "a e f"),
        ("<ul><li>a<ul><li>b</ul></ul>&amp;&lt;", "a\n\nb\n\n&<"),
    ],
)
def test_html(html, want):
    assert prose(html) == want


def test_intents(spark):
    proposal = "# Change:  New  \n## Why\n\n## What Changes\nall of it\n### deeper\nx\n## why\nlate\n## Approach\nby hand\n## Questions\n* a?\n\n - b?\n"
    spec = "intro\n### Requirement: One\nIt SHALL\n  work.\n#### Scenario: s\n- GIVEN  a\n* then b\nno\n#### Scenario: t\n### Requirement: Two\n"
    rows = spark.createDataFrame([("add-my_thing", proposal, [spec, ""]), ("x", "", [])], "change string, proposal string, specs array<string>")
    one, two = (r.i for r in rows.select(markdown.intent(F.col("change"), F.col("proposal"), F.col("specs"), F.col("change")).alias("i")).collect())
    assert one.asDict() == {
        "id": "intent-add-my_thing", "title": "New", "description": "late", "scope": "all of it\n### deeper\nx\n\nApproach: by hand",
        "criteria": ["One: It SHALL work.", "Scenario: s — GIVEN a then b", "Scenario: t", "Two"], "questions": ["a?", "b?"],
    }
    assert two.asDict() == {"id": "intent-x", "title": "X", "description": "X", "scope": "", "criteria": [], "questions": []}


def test_definitions(spark):
    texts = spark.createDataFrame([(1, "A net means what holds. Net: a web.\nnets = no"), (2, "C++ (lang) refers to it"), (3, "net"), (4, None)], "id long, text string")
    terms = spark.createDataFrame([("net",), ("C++ (lang)",), ("absent net",), ("",)], "term string")
    got = sorted(map(tuple, phrases.define(texts, terms).collect()))
    assert got == [(1, "net", "a web"), (1, "net", "what holds"), (2, "C++ (lang)", "it")]


def test_contracts(spark):
    @contracts.contract("test.sum", 1, "k long, total long")
    class First:
        def eval(self, row):
            yield row["k"], -1

    @contracts.contract("test.sum", 1, "k long, total long", finish=lambda rows: rows.groupBy().agg(F.sum("total").alias("all")))
    class Running:
        def __init__(self):
            self.k, self.total = None, 0

        def eval(self, row):
            self.k, self.total = row["k"], self.total + row["v"]

        def terminate(self):
            if self.k is not None:
                yield self.k, self.total

    rows = spark.createDataFrame([(k % 3, k) for k in range(10)], "k long, v long")
    assert contracts.run(rows, "test.sum", by=("k",)).collect()[0]["all"] == 45
    rows.createOrReplaceTempView("contract_test")
    got = spark.sql("SELECT * FROM test_sum(TABLE(SELECT * FROM contract_test) PARTITION BY k)").collect()
    assert sorted(map(tuple, got)) == [(0, 18), (1, 12), (2, 15)]
    with pytest.raises(KeyError):
        contracts.latest("test.none")


def test_pages_are_read_by_range(spark, tmp_path):
    items = spark.createDataFrame([(f"d{k:03}", f"t{k}", None if k % 5 == 0 else f"text {k}\nü", None if k == 0 else "d000") for k in range(53)], "id string, title string, text string, parent string")
    folder = str(tmp_path / "pages")
    save_pages(items, folder, 8, F.pmod(F.xxhash64("id"), F.lit(8)))
    for ranges in (1, 3, 20):
        assert sorted(map(tuple, read_pages(spark, folder, ranges).collect()), key=str) == sorted(map(tuple, items.collect()), key=str)
    reader = PagedReader(folder, 3)
    parts = reader.partitions()
    assert [(p.first, p.stop) for p in parts] == [(0, 3), (3, 6), (6, 8)]
    opened = [{i for b in reader.read(p) for i in b.column(0).to_pylist()} for p in parts]
    assert sum(map(len, opened)) == 53 and not opened[0] & opened[1]  # a task that is lost re-reads its own pages only
    assert PagedReader(str(tmp_path), 3).partitions() == []


def block(text):
    """A document's rows put together as the operator does."""
    import json

    from tessera.sources.richtext import block_rows

    rows = block_rows(text)
    inner = lambda i: ",".join(h + inner(k) + t for k, p, _, _, h, t in rows if p == i)
    assert all(p is None or p < i for i, p, *_ in rows)
    return json.loads("".join(h + inner(i) + t for i, p, _, _, h, t in rows if p is None))["content"]


def shape(nodes):
    """Kinds and texts only."""
    return [n.get("text") if n["type"] == "text" else (n["type"], shape(n.get("content", []))) for n in nodes]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, [("paragraph", [])]),
        (" \n\r\n", [("paragraph", [])]),
        ("a\n b\n\nc", [("paragraph", ["a", ("hardBreak", []), "b"]), ("paragraph", ["c"])]),
        ("## T `x` **y** [l](http://a) http://b\n---", [("heading", ["T ", "x", " ", "y", " ", "l", " ", "http://b"]), ("rule", [])]),
        ("```Py\n- a\n\n# b\n```\nc", [("codeBlock", ["- a\n\n# b"]), ("paragraph", ["c"])]),
        ("~~~ a~b\nopen", [("paragraph", ["~~~ a~b", ("hardBreak", []), "open"])]),
        ("> q\n> - i\n>\n", [("blockquote", [("paragraph", ["q"]), ("bulletList", [("listItem", [("paragraph", ["i"])])])])]),
        ("- a\n    - b\n  - c\n- d\n1. e", [("bulletList", [("listItem", [("paragraph", ["a"]), ("bulletList", [("listItem", [("paragraph", ["b"])])])]), ("listItem", [("paragraph", ["c"])]), ("listItem", [("paragraph", ["d"])])]), ("orderedList", [("listItem", [("paragraph", ["e"])])])]),
        ("|a|b|\n|--|--|\n|1|\nend", [("table", [("tableRow", [("tableHeader", [("paragraph", ["a"])]), ("tableHeader", [("paragraph", ["b"])])]), ("tableRow", [("tableCell", [("paragraph", ["1"])]), ("tableCell", [("paragraph", [])])])]), ("paragraph", ["end"])]),
        ("snake_case_name and *.py or **/*.md", [("paragraph", ["snake_case_name and *.py or **/*.md"])]),
    ],
)
def test_rich_text_blocks(text, want):
    assert shape(block(text)) == want


def test_rich_text_marks_and_levels(spark):
    import json

    from tessera.sources.richtext import markdown_json

    rows = spark.createDataFrame([(1, "### h\n```sql\nx\n```\n`c` [t](u)"), (2, None), (3, "- " + "\n".join("  " * k + f"- l{k}" for k in range(12)))], "tree long, text string")
    got = {r.tree: json.loads(r.json) for r in markdown_json(rows).collect()}
    head, code, text = got[1]["content"]
    assert (head["attrs"], code["attrs"]) == ({"level": 3}, {"language": "sql"})
    assert [n.get("marks") for n in text["content"]] == [[{"type": "code"}], None, [{"type": "link", "attrs": {"href": "u"}}]]
    assert got[2] == {"type": "doc", "version": 1, "content": [{"type": "paragraph", "content": []}]}
    for r in rows.collect():
        assert got[r.tree]["content"] == block(r.text)
    assert markdown_json(spark.createDataFrame([], "tree long, text string")).count() == 0


def test_running_sums_over_a_hot_key(spark):
    from tessera.operators.running import running_sum

    rows = [("hot", k, float(k % 7), "x") for k in range(3000)] + [(None, 1, 2.0, "x"), (None, 2, None, "x"), ("one", 5, 1.5, "x")]
    df = spark.createDataFrame(rows, "k string, t long, v double, _t string").repartition(5)
    got = {(r.k, r.t): (r.total, r._t) for r in running_sum(df, "k", ("t",), F.col("v")).collect()}
    before = {(r.k, r.t): r.total for r in running_sum(df, "k", ("t",), F.col("v"), before=True).collect()}
    want, total = {}, {}
    for k, t, v, x in rows:
        assert before[k, t] == total.get(k, 0.0)
        total[k] = total.get(k, 0.0) + (v or 0.0)
        want[k, t] = (total[k], x)
    assert got == want
