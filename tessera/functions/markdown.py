"""Structure of Markdown as Column expressions: sections, and change proposals as intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = r"(?i)^(GIVEN|WHEN|THEN|AND|BUT)\b"
#: Under which headings the parts of an intent stand, in this order.
DESCRIPTION, SCOPE, APPROACH, QUESTIONS = ("why", "intent", "purpose", "what changes"), ("scope", "what changes", "impact"), ("approach",), ("open questions", "questions")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def cut(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first line that begins with ``mark``, and (title, body) of each such line and what follows it."""
    parts = F.split(text, rf"(?m)^{mark}")
    first_line = lambda p: F.substring_index(p, "\n", 1)
    held = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(strip(first_line(p)).alias("title"), F.substr(p, F.length(first_line(p)) + 1).alias("body")))
    return F.get(parts, F.lit(0)), held


def sections(text: Column) -> Column:
    """Array of (title, body): what stands under each second-level heading, deeper headings included; titles in lower case."""
    return F.transform(cut(text, r"##[ \t]+")[1], lambda s: F.struct(F.lower(s["title"]).alias("title"), strip(s["body"]).alias("body")))


def section(of: Column, names: tuple[str, ...]) -> Column:
    """The body under the first of these headings that has one, the last of equal headings; empty if none has."""
    def under(name: str) -> Column:
        return F.nullif(F.get(F.reverse(F.filter(of, lambda s: s["title"] == name)), F.lit(0))["body"], F.lit(""))

    return F.coalesce(*map(under, names), F.lit(""))


def requirements(text: Column) -> Column:
    """Array of (text, scenarios): each requirement with its statement, and its scenarios with their steps, each in one line."""

    def scenario(s: Column) -> Column:
        bare = F.transform(F.split(s["body"], "\n"), lambda x: F.regexp_replace(strip(x), r"^[-*]+\s*", ""))
        steps = F.transform(F.filter(bare, lambda x: F.rlike(x, F.lit(STEP))), collapse)
        return F.regexp_replace(F.concat(F.lit("Scenario: "), s["title"], F.lit(" — "), F.array_join(steps, " ")), r"[ —]+$", "")

    def requirement(r: Column) -> Column:
        before, held = cut(r["body"], r"####[ \t]+Scenario:")
        said = collapse(before)
        return F.struct(F.when(said == "", r["title"]).otherwise(F.concat_ws(": ", r["title"], said)).alias("text"), F.transform(held, scenario).alias("scenarios"))

    return F.transform(cut(text, r"###[ \t]+Requirement:")[1], requirement)


def humanized(change: Column) -> Column:
    plain = F.lower(F.trim(F.translate(change, "-_", "  ")))
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.substr(plain, F.lit(2)))


def intent(change: Column, proposal: Column, specs: Column, slug: Column) -> Column:
    """A change proposal as (id, title, description, scope, criteria, questions): every requirement and scenario is a criterion."""
    parts = sections(proposal)
    heading = F.regexp_replace(F.trim(F.regexp_extract(proposal, r"(?m)^[ \t]*# (.*)$", 1)), r"(?i)^(proposal|change)\s*:\s*", "")
    scope, approach = section(parts, SCOPE), section(parts, APPROACH)
    wider = strip(F.concat(scope, F.lit("\n\nApproach: "), approach))
    criteria = F.flatten(F.transform(specs, lambda s: F.flatten(F.transform(requirements(s), lambda r: F.concat(F.array(r["text"]), r["scenarios"])))))
    asked = F.transform(F.split(section(parts, QUESTIONS), "\n"), lambda x: F.regexp_replace(strip(x), r"^[-*]+\s*", ""))
    return F.struct(
        F.concat(F.lit("intent-"), slug).alias("id"),
        F.coalesce(F.nullif(heading, F.lit("")), humanized(change)).alias("title"),
        F.coalesce(F.nullif(section(parts, DESCRIPTION), F.lit("")), humanized(change)).alias("description"),
        F.when((approach != "") & ~F.contains(scope, approach), wider).otherwise(scope).alias("scope"),
        criteria.alias("criteria"),
        F.filter(asked, lambda x: x != "").alias("questions"),
    )
