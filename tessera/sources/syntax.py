"""Python files as flat rows: one for each import, definition, base, binding, assignment and call.

The parser only says what is written where; no framework is known here. What a row means is
decided by joins and filters over the rows of all files.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .code import module_of_path

#: ``scope``: qualified name of the innermost definition; ``inside``: of the innermost function, if any;
#: ``caller``: of the outermost; ``owner``: of the innermost class; ``block``: the scope that a name bound
#: here belongs to; ``chain``: the scopes in which a name used here is looked up, innermost first, by spaces;
#: ``form`` of a call: ``name`` for ``f()``, ``member`` for ``x.f()`` whatever x is, else ``other``.
COLUMNS = (
    "path string, module string, what string, name string, scope string, inside string, holder string, first string, second string, "
    "first_name string, second_name string, words string, target string, decorates string, bases string, notes string, line long, "
    "caller string, owner string, block string, chain string, form string"
)
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: Fixed value: rows that a task holds before it hands them on; a file's own rows stay together.
HELD = 5_000


def written(e: ast.expr | None) -> str | None:
    """The string that is written out, in one piece or as a sum."""
    todo, out = [e], []
    while todo:
        match todo.pop():
            case ast.Constant(value=str(part)):
                out.append(part)
            case ast.BinOp(op=ast.Add(), left=left, right=right):
                todo += [left, right]
            case _:
                return None
    return "".join(reversed(out))


def dotted(e: ast.expr | None) -> str | None:
    """``a`` or ``a.b.c`` as it is written; None for anything else."""
    match e:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=value, attr=name) if below := dotted(value):
            return f"{below}.{name}"
    return None


def last_name(e: ast.expr | None) -> str:
    match e:
        case ast.Call(func=f):
            return last_name(f)
        case ast.Attribute(attr=name) | ast.Name(id=name):
            return name
    return ""


def parameters(a: ast.arguments) -> list[ast.arg]:
    return [*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]


class _Flat(ast.NodeVisitor):
    def __init__(self, module: str) -> None:
        self.module, self.rows = module, []
        self.scope, self.inside, self.target = module, None, None
        self.caller, self.owner = None, None
        #: Blocks around this place, outermost first, and whether each is a class; names that a block declares global.
        self.blocks: list[tuple[str, bool]] = [(module, False)]
        self.shared: dict[str, set[str]] = {}

    def put(self, what: str, line: int, **more) -> None:
        block = self.blocks[-1][0]
        # a class's names are seen in its body, not in the functions inside
        seen = [b for k, (b, is_class) in enumerate(self.blocks) if not is_class or k == len(self.blocks) - 1]
        self.rows.append(
            {"module": self.module, "what": what, "scope": self.scope, "inside": self.inside, "line": line, "caller": self.caller, "owner": self.owner, "block": block, "chain": " ".join(reversed(seen)), **more}
        )

    def bind(self, name: str, line: int, kind: str = "local") -> None:
        if name not in self.shared.get(self.blocks[-1][0], ()):
            self.put("bind", line, name=name, holder=kind)

    def within(self, block: str, parameters: list[ast.arg], parts: list[ast.AST], is_class: bool = False) -> None:
        """Visit ``parts`` in a block of their own, which binds ``parameters``."""
        self.blocks.append((block, is_class))
        for p in parameters:
            self.bind(p.arg, p.lineno, "param")
        for part in parts:
            self.visit(part)
        self.blocks.pop()

    def visit_Name(self, n: ast.Name) -> None:
        if isinstance(n.ctx, ast.Store):
            self.bind(n.id, n.lineno)

    def visit_ExceptHandler(self, h: ast.ExceptHandler) -> None:
        if h.name:
            self.bind(h.name, h.lineno)
        self.generic_visit(h)

    def visit_MatchAs(self, m: ast.MatchAs | ast.MatchStar) -> None:
        if m.name:
            self.bind(m.name, m.lineno)
        self.generic_visit(m)

    visit_MatchStar = visit_MatchAs

    def visit_Global(self, g: ast.Global | ast.Nonlocal) -> None:
        self.shared.setdefault(self.blocks[-1][0], set()).update(g.names)

    visit_Nonlocal = visit_Global

    def visit_Lambda(self, f: ast.Lambda) -> None:
        self.within(f"{self.blocks[-1][0]}:{f.lineno}:{f.col_offset}", parameters(f.args), [f.body])

    def comprehension(self, c) -> None:
        self.within(f"{self.blocks[-1][0]}:{c.lineno}:{c.col_offset}", [], [*c.generators, *(getattr(c, part) for part in ("elt", "key", "value") if hasattr(c, part))])

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = comprehension

    def visit_Import(self, s: ast.Import) -> None:
        for a in s.names:
            top = a.name.partition(".")[0]
            self.put("import", s.lineno, name=a.asname or top, holder=a.name if a.asname else top)

    def visit_ImportFrom(self, s: ast.ImportFrom) -> None:
        package = self.module.split(".")[: -s.level] if s.level else []
        for a in s.names:
            self.put("import", s.lineno, name=a.asname or a.name, holder=".".join(filter(None, [*package, s.module, a.name])))

    def define(self, s, kind: str, inside: str | None) -> None:
        own = f"{self.scope}.{s.name}"
        self.put(kind, s.lineno, name=s.name, target=own, bases=" ".join(map(last_name, getattr(s, "bases", []))))
        for d in s.decorator_list:
            if isinstance(d, ast.Call):
                self.call(d, own)
        before = self.scope, self.inside, self.caller, self.owner
        self.scope, self.inside, self.caller = own, inside or self.inside, self.caller or inside
        if kind == "class":
            self.owner = own
        self.within(own, parameters(s.args) if inside else [], s.body, is_class=kind == "class")
        self.scope, self.inside, self.caller, self.owner = before

    def visit_ClassDef(self, s: ast.ClassDef) -> None:
        for base in s.bases:
            if isinstance(base, ast.Name):
                self.put("base", s.lineno, name=base.id, target=f"{self.scope}.{s.name}")
        self.define(s, "class", None)

    def visit_FunctionDef(self, s: ast.FunctionDef) -> None:
        self.define(s, "function", f"{self.scope}.{s.name}")

    visit_AsyncFunctionDef = visit_FunctionDef

    def assign(self, s, targets: list[ast.expr], notes: str) -> None:
        single = targets[0].id if len(targets) == 1 and isinstance(targets[0], ast.Name) else None
        for t in targets:
            if isinstance(t, ast.Name):
                made = last_name(s.value) if isinstance(s.value, ast.Call) else ""
                self.put("set", s.lineno, name=t.id, holder=made, first=written(s.value), notes=notes, target=single)
        before, self.target = self.target, single
        self.generic_visit(s)
        self.target = before

    def visit_Assign(self, s: ast.Assign) -> None:
        self.assign(s, s.targets, "")

    def visit_AnnAssign(self, s: ast.AnnAssign) -> None:
        self.assign(s, [s.target], " ".join(last_name(e) for e in ast.walk(s.annotation) if isinstance(e, ast.expr)))

    def call(self, c: ast.Call, decorates: str | None = None) -> None:
        a, b = [*c.args, None, None][:2]
        words = {k.arg: list(filter(None, map(written, getattr(k.value, "elts", [k.value])))) for k in c.keywords if k.arg}
        form = "name" if isinstance(c.func, ast.Name) else "member" if isinstance(c.func, ast.Attribute) else "other"
        self.put(
            "call", c.lineno, form=form, name=last_name(c), holder=dotted(c.func.value) if isinstance(c.func, ast.Attribute) else None,
            first=written(a), second=written(b), first_name=dotted(a), second_name=dotted(b), words=json.dumps(words), target=self.target, decorates=decorates,
        )
        self.generic_visit(c)

    def visit_Call(self, c: ast.Call) -> None:
        self.call(c)


def syntax_rows(path: str, content: str) -> list[dict]:
    flat = _Flat(module_of_path(path))
    flat.visit(ast.parse(content))
    return flat.rows


def syntax_frames(batches: Iterator) -> Iterator:
    """Frames of syntax rows for frames of files (path, content), of :data:`HELD` rows and a file's more at most: a batch has thousands of files, and a file many rows."""
    import pandas as pd

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_NAMES, dtype=object).astype({"line": "Int64"})

    rows: list[tuple] = []
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                found = syntax_rows(path, content)
            except (SyntaxError, ValueError):
                continue
            rows += [(path, *map(r.get, _NAMES[1:])) for r in found]
            if len(rows) >= HELD:
                yield frame(rows)
                rows = []
    yield frame(rows)


def scan_syntax(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (path, content); a file that can't be parsed gives none, as ``code.extract`` reports it."""
    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(syntax_frames, COLUMNS)


def keyword(name: str | F.Column) -> F.Column:
    """The strings that a call passes for keyword ``name``: null if it doesn't, empty if none is written out."""
    return F.from_json("words", "map<string, array<string>>")[name]


def resolved(rows: DataFrame, column: str, imports: DataFrame) -> DataFrame:
    """``rows`` with ``qualified``: the written name behind its import, or in its own module; null for a path that no import begins."""
    bound = imports.where("what = 'import'").groupBy("path", F.col("name").alias("_head")).agg(F.max_by("holder", "line").alias("_origin"))
    head, rest = F.substring_index(column, ".", 1), F.regexp_replace(column, r"^[^.]*", "")
    own = F.when(~F.contains(F.col(column), F.lit(".")), F.concat_ws(".", "module", column))
    found = rows.withColumn("_head", head).join(bound, ["path", "_head"], "left")
    return found.withColumn("qualified", F.coalesce(F.concat("_origin", rest), own)).drop("_head", "_origin")
