"""Definitions of many terms in many texts: each row's term is its own pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
# The phrases that define a term, and how long what they say may be.
MEANS = r"\s+(?:means|is\s+defined\s+as|is\s+just|refers\s+to|=)\s+([^.\n]{2,160})"
COLON = r"\s*:\s*([^.\n]{2,80})"
#: Words of a term, from its end, that it asks by.
MOST = 4
#: In a text read backwards, what either of them may begin with, and behind it the last words before: ahead, so places may lie close together.
PLACE = r"(?iu)(?:(?:snaem|sa\s+denifed\s+si|tsuj\s+si|ot\s+srefer|=)\s|:)(?=[^\p{L}\p{N}_]*((?:[\p{L}\p{N}_]+[^\p{L}\p{N}_]+){0,%d}[\p{L}\p{N}_]+))" % (MOST - 1)


def definitions(text: Column, term: Column) -> Column:
    """What a text says that ``term`` is, in every place, phrases before colons; the term stands as a whole, in any case."""
    found = lambda form: F.regexp_extract_all(text, F.concat(F.lit(r"(?iu)(?:^|[^\p{L}\p{N}_])\Q"), term, F.lit(r"\E" + form)), F.lit(1))
    return F.filter(F.transform(F.concat(found(MEANS), found(COLON)), lambda v: F.trim(v)), lambda v: v != "")


def phrase_index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term): texts in which a phrase that defines stands behind the last words of a term, which is all that can define it.

    ``texts`` (id, text), ``terms`` (term). A term asks by its last :data:`MOST` words, or all that
    it has; a text is asked by the words before each place where a phrase may begin, so a frequent
    word that nothing is said of there finds nothing. A term without words has no candidates.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    last = lambda c, n: F.array_join(F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n), " ")
    asked = terms.select("term").distinct().select("term", words("term").alias("w")).where("size(w) > 0").select("term", last(F.col("w"), F.lit(MOST)).alias("key"))
    ends = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.reverse("text"), F.lit(PLACE), F.lit(1)))).alias("end")).select("id", words(F.reverse("end")).alias("w"))
    keys = ends.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: last(F.col("w"), n))).alias("key")).distinct()
    return keys.join(asked, "key").select("id", "term").distinct()


def define(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, value): every definition of every term in every text. A text is joined once, with all its candidates, and verified in place."""
    candidates = phrase_index(texts, terms).groupBy("id").agg(F.collect_list("term").alias("terms"))
    rows = texts.join(candidates, "id").select("id", "text", F.explode("terms").alias("term"))
    return rows.select("id", "term", F.explode(definitions(F.col("text"), F.col("term"))).alias("value"))
