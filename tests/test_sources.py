"""Web front-end, mapped classes, page trees, saved facts, resolution and declared rules on small rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.rules import gap_findings
from tessera.operators.resolve import package_placeholders, resolve_includes, resolve_types
from tessera.sources import exports, orm, stores, web
from tessera.sources.fact_tables import Facts


def files(spark, *rows):
    return spark.createDataFrame([(f"/r/src/{p}", c) for p, c in rows], "path string, content string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_routes_of_every_kind(spark):
    found = web.scan_web(
        files(
            spark,
            ("shop/urls.py", 'from shop import views\nurlpatterns = [path("runs/", views.runs), path("x/", View.as_view()), path(f"{y}/", views.y)]\n'),
            ("shop/other.py", 'path("runs/", views.runs)\n'),
            ("shop/sub.py", 'sub = Router()\n\n\n@sub.get("/a")\nasync def a():\n    pass\n\n\n@sub.route("/b", methods=LIST)\ndef b():\n    pass\n\n\n@sub.route("/c")\ndef c():\n    pass\n'),
            ("shop/app.py", 'from shop.sub import sub\napp.mount("/one/", sub)\napp.include_router(sub, prefix="two")\n'),
            ("shop/bad.py", "def broken(:\n"),
            ("shop/none.py", ""),
        )
    )
    got = rows(web.endpoints(found).select("verb", "path", "handler"))
    assert got == sorted(
        [("ANY", "/runs", "shop.views.runs"), *[("GET", f"/{m}/{p}", f"shop.sub.{p}") for m in ("one", "two") for p in "ac"]], key=str
    )


def test_calls_need_a_client_library_and_an_endpoint(spark):
    served = ("shop/api.py", 'r = APIRouter()\n\n\n@r.get("/a")\ndef a():\n    pass\n')
    call = 'def f(c):\n    return c.get("https://host/a/#top")\n\n\nc.get("/a")\nc.get()\nc.request("BREW", "/a")\n'
    with_library = web.scan_web(files(spark, served, ("shop/use.py", "import requests as q\n" + call)))
    assert rows(web.consumes(with_library).select("caller", "path")) == [("shop.use", "/a"), ("shop.use.f", "/a")]
    assert web.consumes(web.scan_web(files(spark, served, ("shop/use.py", call)))).count() == 0


def test_mapped_classes(spark):
    found = orm.scan_orm(files(spark, ("app/m.py", 'class A(Model):\n    class Meta:\n        db_table = "aa"\n    up = ForeignKey("app.A")\n    to = ForeignKey("app.B")\n'), ("app/n.py", 'class B:\n    __tablename__ = "bb"\n    x = Column()\n')))
    edges = rows(orm.data_edges(found).where("kind = 'REFERENCES'").select("src", "dst"))
    assert edges == [("py:entity:aa", "py:entity:bb")]  # none to itself
    assert rows(orm.classes(found)) == [("A", "aa"), ("B", "bb")]


def test_tree_with_a_cycle(spark):
    children = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "a"), ("b", "d"), ("d", "e"), ("c", "d")], "parent string, id string")
    assert [tuple(r) for r in stores.fetch_tree(children, "a", 2, 10).orderBy("depth", "id").collect()] == [("a", 0, False), ("b", 1, False), ("c", 1, False), ("d", 2, False)]
    assert [r.id for r in stores.fetch_tree(children, "a", 9, 3).orderBy("depth", "id").collect()] == ["a", "b", "c"]
    assert all(r.truncated for r in stores.fetch_tree(children, "a", 9, 3).collect())
    assert rows(stores.fetch_tree(children, "lonely", 3, 3)) == [("lonely", 0, False)]


def small_facts(spark):
    nodes = spark.createDataFrame([("a", "Module", "a", "py", "a.py", 1, 2, False, 1)], "id string, kind string, name string, language string, file string, line long, end_line long, external boolean, seq long")
    return Facts(nodes, spark.createDataFrame([("a", "b", "CALLS", "a.py", 1, 1)], "src string, dst string, kind string, file string, line long, seq long"))


def test_fact_cache(spark, tmp_path, monkeypatch):
    built = []

    def build():
        built.append(1)
        return small_facts(spark)

    folder = str(tmp_path)
    assert stores.load_or_build(spark, folder, None, "v1", build)[1] is False and len(built) == 1
    for fingerprint, hit in (("v1", False), ("v1", True), ("v2", False)):
        got, was = stores.load_or_build(spark, folder, "abc", fingerprint, build)
        assert was is hit and got.nodes.count() == 1
    assert len(built) == 3
    monkeypatch.setattr(exports, "FORMAT_VERSION", exports.FORMAT_VERSION + 1)
    with pytest.raises(ValueError, match="version"):
        exports.load(spark, f"{folder}/abc/v1")
    assert stores.load_or_build(spark, folder, "abc", "v1", build)[1] is False and len(built) == 4


def test_trial_ddl_leaves_nothing(spark):
    before = {x.name for x in spark.catalog.listDatabases()}
    done, error, tables = stores.try_ddl(spark, ["CREATE TABLE {db}.t (a INT) USING parquet", "CREATE TABLE nonsense"])
    assert done == 1 and error and [t[:4] for t in tables] == [("t", False, "a", "int")]
    assert stores.try_ddl(spark, []) == (0, "", [])
    assert {x.name for x in spark.catalog.listDatabases()} == before


def test_ambiguous_names_resolve_to_nothing(spark):
    refs = spark.createDataFrame([("p", "f", "A"), ("p", "f", "B"), ("q", "f", "C"), (None, None, None)], "package string, file string, name string")
    types = spark.createDataFrame([("q", "A"), ("r", "A"), ("q", "B")], "package string, name string")
    imports = spark.createDataFrame([("f", "C", "x.C"), ("f", "C", "y.C")], "file string, name string, target string")
    assert rows(resolve_types(refs, types, imports, unique_simple=True).select("name", "type")) == sorted([("A", None), ("B", "q.B"), ("C", None), (None, None)], key=str)


def test_includes(spark):
    known = spark.createDataFrame([("a/x.h",), ("b/x.h",), ("b/only.h",), ("top.h",)], "file string")
    asked = [("a/m.c", i) for i in ("x.h", "../b/x.h", "../../x.h", "top.h", "z/only.h", "z/x.h", "", None)]
    got = dict(resolve_includes(spark.createDataFrame(asked, "file string, include string"), known).select("include", "target").collect())
    assert got == {"x.h": "a/x.h", "../b/x.h": "b/x.h", "../../x.h": None, "top.h": "top.h", "z/only.h": "b/only.h", "z/x.h": None, "": None, None: None}


def test_placeholders(spark):
    ids = spark.createDataFrame([("ts:react:useState",), ("ts:react:useState",), ("ts:react:useRef",), ("ts:src/a",), (None,)], "id string")
    assert rows(package_placeholders(ids)) == [("ts:react", "Module", "react"), ("ts:react:useRef", "Function", "useRef"), ("ts:react:useState", "Function", "useState")]


def test_declared_rules(spark):
    data = spark.createDataFrame([(1, None, None), (2, "  long enough ", ["q"]), (3, "", [])], "id long, text string, open array<string>")
    rule = lambda **r: {"description": "", "severity": "warning", **r}
    rules = [rule(id="present", check="field_present", field="text"), rule(id="length", check="min_length", field="text", length=11), rule(id="none", check="max_items", field="open", count=0), rule(id="some", check="min_items", field="open", count=1), rule(id="list", check="field_present", field="open")]
    assert rows(gap_findings(data, rules).select("id", "rule")) == sorted([(i, r) for i in (1, 3) for r in ("present", "length", "some", "list")] + [(2, "none")], key=str)
    for bad in (rule(id="x", check="max_words", field="text"), rule(id="x", check="min_length", field="nothing", length=1)):
        with pytest.raises(ValueError, match="unknown"):
            gap_findings(data, [bad])


def test_blame(spark):
    sha = "0123456789" * 4
    text = f"{sha} 1 2 1\nauthor x\n\t{sha} 5 6\n{sha} 4 3\n\tcode\nabc 1 2\n"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(stores.blame_lines(F.col("t")).alias("b"))
    assert [None if r.b is None else [(x.line, x.sha) for x in r.b] for r in df.collect()] == [[(2, sha), (3, sha)], [], None]
