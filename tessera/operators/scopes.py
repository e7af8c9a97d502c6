"""Names looked up through nested scopes, and what a call means in each language.

A name used somewhere is looked up in a chain of scopes, innermost first; the first scope
that binds it decides, so a parameter or a local hides what lies outside. Chains are short,
so they are spread out and met by equality on (file, scope, name): no positions are compared.

Rows, of whatever language: ``calls`` (file, caller, owner, holder, name, line, chain) with
``owner`` the enclosing type, ``holder`` what stands before the dot, or null, and ``chain`` an
array of scopes; ``binds`` (file, scope, name, what, target), ``target`` null where a name
stands for something unknown; ``methods`` (owner, name). A rule gives ``calls`` that it
resolves with ``target``; a call that it can't resolve precisely gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of several bindings of a name in one scope the first of these holds.
BINDINGS = ("param", "local", "import", "namespace", "function", "class")


def nearest_binding(uses: DataFrame, binds: DataFrame, name: str = "name", prefer: tuple[str, ...] = BINDINGS) -> DataFrame:
    """``uses`` (file, ``name``, chain, ...) with ``bound`` (scope, what, target) of the innermost scope that binds the name, or null.

    Names that are used alike are looked up once, so a hot name is one row a file and chain.
    """
    rank = F.array_position(F.array(*map(F.lit, prefer)), F.col("what"))
    one = binds.where(F.col("what").isin(*prefer)).groupBy("file", "scope", F.col("name").alias("_n")).agg(F.min(F.struct(rank.alias("r"), "what", "target")).alias("_b"))
    asked = uses.select("file", F.col(name).alias("_n"), "chain").distinct()
    spread = asked.select("file", "_n", "chain", F.posexplode("chain").alias("_depth", "scope"))
    found = spread.join(one, ["file", "scope", "_n"]).groupBy("file", "_n", "chain").agg(
        F.min_by(F.struct("scope", F.col("_b.what").alias("what"), F.col("_b.target").alias("target")), "_depth").alias("bound")
    )
    return uses.join(found.withColumnRenamed("_n", name), ["file", name, "chain"], "left")


def _siblings(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """``calls`` with ``sibling``: whether the enclosing type has a method of that name."""
    own = methods.select("owner", "name").distinct().withColumn("sibling", F.lit(True))
    return calls.join(own, ["owner", "name"], "left").withColumn("sibling", F.coalesce("sibling", F.lit(False)))


def _kept(calls: DataFrame, target: Column, columns: list[str]) -> DataFrame:
    return calls.withColumn("target", target).where("target IS NOT NULL").select(*columns, "target")


def python_targets(calls: DataFrame, binds: DataFrame, methods: DataFrame) -> DataFrame:
    """A bare name by its nearest binding, if that is an import or a definition of the module; a method of the class through ``self``; a member of an import."""
    import builtins

    heads = calls.withColumn("head", F.coalesce("holder", "name"))
    rows = _siblings(nearest_binding(heads, binds, "head"), methods)
    imported = F.col("bound.what").isin("import", "namespace")
    of_module = F.col("bound.what").isin("function", "class") & (F.col("bound.scope") == F.element_at("chain", -1))
    bare = F.when(~F.col("name").isin(*dir(builtins)) & (imported | of_module), F.col("bound.target"))
    member = F.when((F.col("holder") == "self") & F.col("sibling"), F.concat_ws(".", "owner", "name")).when(imported, F.concat_ws(".", "bound.target", "name"))
    return _kept(rows, F.when(F.col("holder").isNull(), bare).otherwise(member), calls.columns)


def c_targets(calls: DataFrame, binds: DataFrame) -> DataFrame:
    """Any global name, but none that the function binds itself: a call through a pointer has no known target. A static function is its file's own."""
    rows = nearest_binding(calls.where("holder IS NULL"), binds, prefer=("param", "local", "function"))
    target = F.when(F.col("bound.what").isin("param", "local"), None).otherwise(F.coalesce("bound.target", F.concat(F.lit("c:"), "name")))
    return _kept(rows, target, calls.columns)


def cpp_targets(calls: DataFrame, binds: DataFrame, methods: DataFrame) -> DataFrame:
    """A sibling method, then a free function of the file, then the name; a qualified name as it stands; ``this->m`` if it is a sibling."""
    rows = _siblings(nearest_binding(calls, binds, prefer=("function",)), methods)
    own = F.when(F.col("sibling"), F.concat_ws("::", "owner", "name"))
    bare = F.coalesce(own, "bound.target", F.concat(F.lit("cpp:"), "name"))
    qualified = F.when(F.col("holder").endswith("::"), F.concat(F.lit("cpp:"), "holder", "name"))
    return _kept(rows, F.when(F.col("holder").isNull(), bare).when(F.col("holder") == "this", own).otherwise(qualified), calls.columns)


def java_targets(calls: DataFrame, methods: DataFrame, imports: DataFrame) -> DataFrame:
    """A bare or ``this`` call of a sibling method; a static call on a type that an import or the package gives; a variable's type is unknown.

    ``calls`` has ``package`` too; ``imports`` (file, name, target).
    """
    rows = _siblings(calls, methods).join(imports.groupBy("file", F.col("name").alias("holder")).agg(F.max("target").alias("_i")), ["file", "holder"], "left")
    own = F.when(F.col("sibling"), F.concat_ws(".", "owner", "name"))
    of_package = F.when(F.col("package") != "", F.concat(F.lit("java:"), "package", F.lit("."), "holder"))
    static = F.when(F.rlike("holder", F.lit(r"^\p{Lu}")), F.concat_ws(".", F.coalesce("_i", of_package), "name"))
    target = F.when(F.col("holder").isNull() | (F.col("holder") == "this"), own).when(F.coalesce("_i", of_package).isNotNull(), static)
    return _kept(rows, target, calls.columns)


def ts_targets(calls: DataFrame, binds: DataFrame, methods: DataFrame) -> DataFrame:
    """A function of the module, then an imported binding; ``this.m`` if it is a sibling; a member of an imported namespace, and of no other import."""
    heads = calls.withColumn("head", F.coalesce("holder", "name"))
    rows = _siblings(nearest_binding(heads, binds, "head", prefer=("function", "namespace", "import")), methods)
    what = F.col("bound.what")
    bare = F.when(what == "function", F.col("bound.target")).when(what.isNotNull(), F.concat_ws(".", "bound.target", "name"))
    own = F.when(F.col("sibling"), F.concat_ws(".", "owner", "name"))
    member = F.when(what == "namespace", F.concat_ws(".", "bound.target", "name"))
    return _kept(rows, F.when(F.col("holder").isNull(), bare).when(F.col("holder") == "this", own).otherwise(member), calls.columns)


def go_targets(calls: DataFrame, binds: DataFrame, methods: DataFrame) -> DataFrame:
    """A function of the same file, or a method of the receiver's own type through the receiver; ``calls`` has ``receiver``, the variable's name, too."""
    rows = _siblings(nearest_binding(calls, binds, prefer=("function",)), methods)
    own = F.when((F.col("holder") == F.col("receiver")) & F.col("sibling"), F.concat_ws(".", "owner", "name"))
    return _kept(rows, F.when(F.col("holder").isNull(), F.col("bound.target")).otherwise(own), calls.columns)
