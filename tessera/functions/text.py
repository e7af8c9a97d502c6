"""Text and scalar functions as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning in a name or a sentence.
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "into", "when", "are", "was"]
#: Suffixes that say what a thing is, not what it is about.
GENERIC = ["controller", "service", "repository", "model", "error", "manager", "handler"]

SECRET_RULES = [
    ("aws_key", r"AKIA[0-9A-Z]{16}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("assigned_secret", r"(?i)(api_?key|secret|token|passwd|password)\s*[:=]\s*[\"'][^\"']{8,}[\"']"),
]
#: A value that stands for a secret without being one.
PLACEHOLDER = r"(?i)(example|changeme|placeholder|your_|xxxx|<[^>]+>)"


def identifier_tokens(text: Column) -> Column:
    """camelCase and snake_case parts, lower case, longer than two, without stop words and a plural s, distinct."""
    parts = F.split(F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^\p{L}\p{N}]+")
    kept = F.filter(parts, lambda x: (F.length(x) > 2) & ~x.isin(STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda x: F.when((F.length(x) > 3) & x.endswith("s") & ~x.endswith("ss"), F.left(x, F.length(x) - 1)).otherwise(x)))


def word_tokens(text: Column) -> Column:
    """Letters and digits only, lower case, longer than two, distinct."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "), " +"), lambda x: F.length(x) > 2))


def acronym_tokens(name: Column) -> Column:
    """HTTPServerError -> http, server, error."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), lambda x: F.lower(x))


def meaningful(tokens: Column) -> Column:
    """Without generic suffixes, unless nothing else is left."""
    rest = F.array_except(tokens, F.array(*[F.lit(g) for g in GENERIC]))
    return F.when(F.size(rest) > 0, rest).otherwise(tokens)


def normal_name(name: Column) -> Column:
    """Lower case, no underscores or spaces, one trailing s dropped from names longer than three."""
    bare = F.regexp_replace(F.lower(name), "[_ ]", "")
    return F.when((F.length(bare) > 3) & bare.endswith("s"), F.left(bare, F.length(bare) - 1)).otherwise(bare)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; NULL where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def collapse(text: Column) -> Column:
    """One space between words, trimmed, lower case, closing punctuation dropped."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"[.,;:!?]+$", "")


def heading_anchor(heading: Column) -> Column:
    """The anchor of a heading: lower case, visible marks dropped, spaces to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}_ -]", ""), " ", "-")


def file_slug(name: Column, default: str = "module", most: int = 80) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(bare, F.lit(most)), F.lit("")), F.lit(default))


def url_path(url: Column) -> Column:
    """The path of a URL, with one leading and no trailing slash."""
    return F.concat(F.lit("/"), F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), r"^/+|/+$", ""))


def module_name(path: Column) -> Column:
    """src/a/b/__init__.py -> a.b"""
    return F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.py$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))


def duration(seconds: Column) -> Column:
    """Rounded up to minutes, one at least: 2h 5m, 5m, 3h."""
    minutes = F.greatest(F.lit(1), F.ceil(seconds / 60)).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    return F.when(hours == 0, F.format_string("%dm", rest)).when(rest == 0, F.format_string("%dh", hours)).otherwise(F.format_string("%dh %dm", hours, rest))


def within_tolerance(claimed: Column, actual: Column, tolerance: float) -> Column:
    """Relative to the actual value, absolute where that is 0."""
    return F.when(actual == 0, F.abs(claimed) <= tolerance).otherwise(F.abs(claimed - actual) <= tolerance * F.abs(actual))


def entity_key(text: Column) -> dict[str, Column]:
    """Parts of ``Component_vVersion::Region::Interface``; all NULL where the text isn't one."""
    form = r"^(.+)_v([^:]+)::([^:]+)::([^:]+)$"
    ok = F.rlike(text, F.lit(form))
    return {n: F.when(ok, F.regexp_extract(text, form, k)) for k, n in enumerate(("component", "version", "region", "interface"), 1)}


def predicate(op: str, actual: Column, expected=None) -> Column:
    """A named test of a value; a NULL value fails every one."""
    tests = {
        "eq": lambda: actual == expected,
        "ne": lambda: actual != expected,
        "gt": lambda: actual > expected,
        "ge": lambda: actual >= expected,
        "lt": lambda: actual < expected,
        "le": lambda: actual <= expected,
        "not_empty": lambda: F.length(actual.cast("string")) > 0,
        "len_gt": lambda: F.length(actual.cast("string")) > expected,
        "len_ge": lambda: F.length(actual.cast("string")) >= expected,
        "in": lambda: actual.isin(list(expected)),
        "in_range": lambda: actual.between(*expected),
    }
    if op not in tests:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(tests[op](), F.lit(False))


def confidence_band(value: Column, threshold: float, band: float = 0.1) -> Column:
    """fail, warn or pass; what isn't a number from 0 to 1 fails."""
    x = value.try_cast("double")
    return (
        F.when(x.isNull() | (x < 0) | (x > 1) | (x < threshold * (1 - band)), "fail").when(x < threshold, "warn").otherwise("pass")
    )


def can_drift(kind, text):
    """Whether an unbound mention counts against its document: only what can't be meant as prose, a setting or a foreign path."""
    foreign = F.rlike(text, F.lit(r"^(/|~|\.\.)|[* ]"))
    prose = (kind == "camel") | F.rlike(text, F.lit("^[A-Z][A-Z0-9_]+$"))
    return ~prose & ~((kind == "file") & foreign) & ~((kind == "backtick") & F.rlike(text, F.lit("^[a-z][a-z0-9]*$")))


# The forms in which a text names code, file endings, ends of addresses, and abbreviations.
BACKTICKED = r"`([^`\n]{2,120})`"
DOTTED = r"\b[a-z_]\w*(?:\.[A-Za-z_]\w*){2,}\b"
SNAKE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
CAMEL = r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b"
MENTIONED_NAME = r"[A-Za-z_][\w.]*"
MENTIONED_FILE = r"\.(py|md|ttl|json|yaml|toml)$"
URL_TAILS = ("com", "net", "org", "io", "dev", "ai", "html", "www")
ABBREVIATIONS = ("e_g", "i_e")


def mentions(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, mention, kind): what texts name as code, each once; of several forms the first of file, backtick, dotted, snake and camel."""
    found = F.regexp_extract_all(text, F.lit(BACKTICKED), F.lit(1))
    plain = F.regexp_replace(text, BACKTICKED, " ")
    every = lambda pattern: F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
    form = lambda rank, kind, m: F.struct(F.lit(rank).alias("rank"), kind.alias("kind"), m.alias("mention"))
    quoted = F.transform(found, lambda x: F.btrim(F.trim(x), F.lit("()")))
    kind = lambda m: F.when(F.contains(m, F.lit("/")) | F.rlike(m, F.lit(MENTIONED_FILE)), "file").when(F.rlike(m, F.lit(f"^{MENTIONED_NAME}$")), "backtick")
    forms = F.concat(
        F.transform(quoted, lambda m: form(1, kind(m), m)),
        F.transform(F.filter(every(DOTTED), lambda m: ~F.lower(F.substring_index(m, ".", -1)).isin(*URL_TAILS)), lambda m: form(2, F.lit("dotted"), m)),
        F.transform(F.filter(every(SNAKE), lambda m: ~m.isin(*ABBREVIATIONS)), lambda m: form(3, F.lit("snake"), m)),
        F.transform(every(CAMEL), lambda m: form(4, F.lit("camel"), m)),
    )
    rows = pages.select(key, F.explode(forms).alias("x")).where("x.kind IS NOT NULL AND x.mention <> ''")
    return rows.groupBy(key, F.col("x.mention").alias("mention")).agg(F.min_by("x.kind", "x.rank").alias("kind"))
