"""HTTP routes and client calls of Python files, joined into endpoints.

Files become flat syntax rows; routers, mounts, routes and calls are filters over them, and
everything between rows is a join: a name with its import, a call with its file's libraries,
a route with its router's prefix and mounts, a call with its endpoint by verb and path. What
is computed rather than written out gives no row. Rows of other languages' front-ends can
take part as soon as they have these columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .syntax import keyword, resolved, scan_syntax

# Names that frameworks and client libraries give these things.
ROUTE_VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
CALL_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
ROUTERS = {"APIRouter": "prefix", "Blueprint": "url_prefix", "Router": "prefix"}
MOUNTS = {"include_router": "prefix", "register_blueprint": "url_prefix", "mount": "prefix"}
URL_CONF = ("path", "re_path", "url")
CLIENTS = ("httpx", "requests", "aiohttp", "urllib3", "http")


def scan_web(files: DataFrame) -> DataFrame:
    return scan_syntax(files)


def one_slash(*parts: Column) -> Column:
    """Path segments with one slash between them and one in front."""
    bare = [F.nullif(F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", ""), F.lit("")) for p in parts]
    return F.concat(F.lit("/"), F.concat_ws("/", *bare))


def called_path(value: Column) -> Column:
    """The path of a called address: without host, query or closing slashes."""
    path = F.when(value.contains("://"), F.regexp_replace(F.regexp_replace(value, r"^[^:]*://[^/?#]*", ""), r"[?#].*$", "")).otherwise(value)
    return F.concat(F.lit("/"), F.regexp_replace(path, "^/|/+$", ""))


def _prefix(names: dict[str, str]) -> Column:
    """The prefix keyword of a call by its name."""
    given = F.coalesce(*[F.when(F.col("name") == n, keyword(k)[0]) for n, k in names.items()])
    return F.coalesce(given, F.lit(""))


def routers(rows: DataFrame) -> DataFrame:
    """(key, prefix): routers by qualified name; of two assignments the later holds."""
    made = rows.where(F.col("what") == "call").where(F.col("name").isin(*ROUTERS) & F.col("target").isNotNull())
    return made.groupBy(F.concat_ws(".", "module", "target").alias("key")).agg(F.max_by(_prefix(ROUTERS), "line").alias("prefix"))


def mounts(rows: DataFrame) -> DataFrame:
    """(key, mount): what is put in front of a router by those that include it."""
    calls = rows.where(F.col("what") == "call").where(F.col("name").isin(*MOUNTS))
    at_path = (F.col("name") == "mount") & F.col("second_name").isNotNull()
    named = calls.select("path", "module", F.when(at_path, F.col("second_name")).otherwise(F.col("first_name")).alias("router"), F.when(at_path, F.coalesce("first", F.lit(""))).otherwise(_prefix(MOUNTS)).alias("mount"))
    return resolved(named.where("router IS NOT NULL"), "router", rows).where("qualified IS NOT NULL").select(F.col("qualified").alias("key"), "mount")


def routes(rows: DataFrame) -> DataFrame:
    """(key, verb, value, handler, line): decorators of handlers, and the lists of files named urls.py, whose key is empty."""
    calls = rows.where("what = 'call' AND first IS NOT NULL")
    methods = keyword("methods")
    verbs = F.when(F.col("name").isin(*ROUTE_VERBS), F.array("name")).when(F.col("name").isin("route", "add_url_rule"), F.coalesce(methods, F.array(F.lit("get"))))
    decorated = calls.where("decorates IS NOT NULL AND holder IS NOT NULL AND NOT contains(holder, '.')").withColumn("verb", F.explode(verbs))
    by_mark = decorated.select(F.concat_ws(".", "module", "holder").alias("key"), F.upper("verb").alias("verb"), F.col("first").alias("value"), F.col("decorates").alias("handler"), "line")
    listed = calls.where(F.col("path").endswith("urls.py") & F.col("name").isin(*URL_CONF) & F.col("second_name").isNotNull())
    views = resolved(listed, "second_name", rows).where("qualified IS NOT NULL")
    return by_mark.unionByName(views.select(F.lit("").alias("key"), F.lit("ANY").alias("verb"), F.col("first").alias("value"), F.col("qualified").alias("handler"), "line"))


def endpoints(rows: DataFrame) -> DataFrame:
    """(verb, path, handler, line): each route under every mount of its router; without one, at its own path."""
    whole = routes(rows).join(routers(rows), "key", "left").join(mounts(rows), "key", "left")
    return whole.select("verb", one_slash(F.col("mount"), F.col("prefix"), F.col("value")).alias("path"), "handler", "line")


def client_calls(rows: DataFrame) -> DataFrame:
    """(caller, verb, path, line) of calls on an object, in files that import a client library."""
    users = rows.where(F.col("what") == "import").where(F.substring_index("holder", ".", 1).isin(*CLIENTS)).select("path").distinct()
    calls = rows.where("what = 'call' AND form = 'member' AND decorates IS NULL").join(users, "path", "left_semi")
    plain = F.col("name").isin(*CALL_VERBS) & (F.length("first") > 0)
    spelt = (F.col("name") == "request") & F.lower("first").isin(*CALL_VERBS) & (F.length("second") > 0)
    asked = calls.where(plain | spelt)
    verb, value = F.when(plain, F.col("name")).otherwise(F.col("first")), F.when(plain, F.col("first")).otherwise(F.col("second"))
    return asked.select(F.coalesce("inside", "module").alias("caller"), F.upper(verb).alias("verb"), called_path(value).alias("path"), "line")


def consumes(rows: DataFrame) -> DataFrame:
    """(caller, verb, path, line) of calls to endpoints that the same files serve; others give no row."""
    return client_calls(rows).join(endpoints(rows).select("verb", "path").distinct(), ["verb", "path"], "left_semi").select("caller", "verb", "path", "line")
