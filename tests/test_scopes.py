"""Names through scopes on small Python files, against what Python itself binds; substring joins against brute force."""

import random
import symtable

from tessera.operators.links import substring_join
from tessera.sources.calls import resolved_bases, resolved_calls
from tessera.sources.syntax import scan_syntax


def edges(spark, *files):
    rows = scan_syntax(spark.createDataFrame([(f"/r/src/{p}", c) for p, c in files], "path string, content string"))
    return sorted((r.src.removeprefix("py:"), r.dst.removeprefix("py:")) for r in resolved_calls(rows).collect())


HEAD = "from lib import run, stop as halt\nimport tools\n\ndef helper(): pass\n\n"


def test_what_hides_a_name(spark):
    content = HEAD + """
def plain(): return run(helper(tools.go()))
def by_param(run, *halt, **tools): return run(halt(tools.go()))
def by_local():
    run = 1
    for halt in (): halt()
    with x as helper: helper()
    return run()
def by_handler():
    try: halt()
    except E as halt: pass
def by_walrus(): return (run := 1) and run()
def outer(run):
    def inner(): return run(), helper()
    return inner
def declared():
    global run
    run = 2
    return run()
def by_lambda(): return (lambda run: run())(1), run()
def by_comprehension(): return [run() for run in x], run()
def by_match(x):
    match x:
        case [run, *halt]: return run(), halt()
def builtin(): return len(print())
def nested():
    def helper(): pass
    return helper()
def on_a_call(): return run().stop().helper()
class A:
    run = 1
    def m(self): return self.n(), run(), self.run(), self.a.n()
    def n(self): return helper()
    class B:
        def m(self): return self.n()
"""
    got = edges(spark, ("m.py", content))
    want = [("plain", "lib.run"), ("plain", "m.helper"), ("plain", "tools.go"), ("outer", "m.helper"), ("declared", "lib.run"), ("by_lambda", "lib.run"), ("by_comprehension", "lib.run")]
    want += [("on_a_call", "lib.run"), ("A.m", "m.A.n"), ("A.m", "lib.run"), ("A.n", "m.helper")]
    assert got == sorted((f"m.{a}", b) for a, b in want)


def test_against_the_compilers_symbol_tables(spark):
    """In random files a bare call has an edge just where the compiler says that the name is the module's."""
    rnd, files, want = random.Random(4), [], []
    names = ["run", "halt", "helper", "other"]
    for k in range(40):
        body = HEAD
        for f in range(4):
            a, b, c, d = (rnd.choice(names) for _ in range(4))
            body += f"def f{f}({a}):\n    {b} = 1\n    def inner({c}): return {d}()\n    return {rnd.choice(names)}()\n"
        files.append((f"k{k}.py", body))
        targets = {"run": "lib.run", "halt": "lib.stop", "helper": f"k{k}.helper"}
        table = symtable.symtable(body, "k", "exec")
        for line, text in enumerate(body.split("\n"), 1):
            if not text.startswith("    ") or "()" not in text:
                continue
            name = text.rsplit(" ", 1)[1].removesuffix("()")
            outer = next(c for c in table.get_children() if c.get_lineno() <= line < c.get_lineno() + 4 and c.get_name()[0] == "f")
            block = next(c for c in outer.get_children() if c.get_name() == "inner") if "inner" in text else outer
            if block.lookup(name).is_global() and name in targets:
                want.append((f"k{k}.{outer.get_name()}", targets[name]))
    assert edges(spark, *files) == sorted(want)


def test_bases(spark):
    rows = scan_syntax(spark.createDataFrame([("/r/src/m.py", "from lib import A as B\nclass C(B): pass\nclass D(C, Exception, lib.X): pass\n")], "path string, content string"))
    got = sorted((r.src, r.dst, r.external) for r in resolved_bases(rows).collect())
    assert got == [("py:m.C", "py:lib.A", False), ("py:m.D", "py:Exception", True), ("py:m.D", "py:m.C", False)]


def test_substring_join(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab/.") for _ in range(rnd.randrange(12))) for _ in range(80)] + ["", "ab"]
    asked = ["".join(rnd.choice("ab/.") for _ in range(rnd.randrange(6))) for _ in range(80)] + ["", "a", "zz", "abababababab", "漢"]
    got = {tuple(r) for r in substring_join(spark.createDataFrame([(m,) for m in asked] + [(None,)], "q string"), "q", spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string"), "t").collect()}
    assert got == {(m, t) for m in asked if m for t in texts if m in t}
