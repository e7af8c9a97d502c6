"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Everything is a DataFrame expression. Texts are cut into tokens (runs of letters, digits
and underscores, or runs of other visible characters), and every token and every pair of
neighbouring tokens falls into one of ``buckets`` hash buckets. Two multinomials over the
buckets are counted, one over all documents and one over the trusted ones; a document's
score is the mean over its n-grams of log(p_target / p_raw), so length plays no part. It
is kept if the score reaches ``threshold``, which is fixed: equal texts always get equal
verdicts, and nothing is drawn at random.

Only the table of log ratios travels to the executors: ``buckets`` doubles, whatever the
size of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, spread

TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
SYMBOL = "[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
VISIBLE = r"[^\x20\x09-\x0D]"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more.

    Windows are compared by 64-bit hash. Texts whose windows all differ, most of them,
    end after one hash-set pass; the others sort their windows once.
    """

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) & (j > 0)
                | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)),
            )
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return bind(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - at, F.lit(3)))),
                    F.lit(0).cast("long"),
                    lambda total, add: total + add,
                ),
            )

        return bind(pairs, of_sorted)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = bind(
        hashes,
        lambda h: F.transform(
            F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda third, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), third),
        ),
    )
    return bind(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)),
    )


def base_measures(text: Column) -> dict[str, Column]:
    """Counts of one text, as the docstring of :func:`quality_rules` defines them."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(VISIBLE)))
    return {
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def ngram_buckets(text: Column, buckets: int) -> Column:
    """Buckets of all tokens and all pairs of neighbours of a text."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    n = F.lit(buckets)
    return bind(
        hashes,
        lambda h: F.concat(
            F.transform(h, lambda x: F.pmod(x, n).cast("int")),
            F.transform(
                F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))),
                lambda x, i: F.pmod(F.xxhash64(F.get(h, i), x), n).cast("int"),
            ),
        ),
    )


def log_ratios(docs: DataFrame, trusted: Column, text_col: str, buckets: int, prior: float = 5.0) -> list[float]:
    """log(p_target / p_raw) for each bucket, from all documents.

    A bucket's lift, what the target has over what it would have if it were like the raw
    corpus, is shrunk to 1 by ``prior`` n-grams on both sides: a few expected n-grams say
    little, many say what they say however small the target is, and a target without
    documents gives 0 everywhere. The lifts are then scaled so that p_target sums to 1.
    A list of ``buckets`` numbers: its size doesn't follow the corpus.
    """
    counts = (
        docs.select(
            F.explode(ngram_buckets(F.coalesce(F.col(text_col), F.lit("")), buckets)).alias("bucket"),
            F.coalesce(trusted, F.lit(False)).cast("long").alias("trusted"),
        )
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    )
    raw, target = [0] * buckets, [0] * buckets
    for row in counts.collect():  # one row a bucket at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    share = sum(target) / max(sum(raw), 1)
    lifts = [(t + prior) / (r * share + prior) for t, r in zip(target, raw, strict=True)]
    whole = sum(r * x for r, x in zip(raw, lifts, strict=True)) / max(sum(raw), 1) or 1.0
    return [math.log(x / whole) if r else 0.0 for r, x in zip(raw, lifts, strict=True)]  # a bucket that no text has says nothing


def quality_rules(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 10_000,
    threshold: float = -0.25,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    into: str = "quality",
) -> DataFrame:
    """``docs`` with its columns, one row for each of its rows, and the verdicts in column ``into``.

    ``trusted_ids`` is a table with ``id_col``; documents with such an id form the target.
    ``into`` is a struct, so that no column of ``docs`` can clash with its fields (one named
    ``into`` is replaced):

    * n_words: runs of non-white-space; word_chars: code points in them;
    * n_symbols: characters of ``#*$%&|<>``;
    * n_dup_lines: lines (cut at newlines) that hold a word and equal an earlier line;
    * n_repeat_words: words in 3-word windows that the text has twice or more;
    * base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` per
      cent of them repeated; llr: the score, 0 for a text without tokens;
    * kept: not base_failed, and llr >= ``threshold``.

    A null text counts as empty: no words, base_failed. A null id is trusted by nobody.
    Repeated rows are judged alike, and equal scores get equal verdicts. Very long texts
    count whole. An empty ``docs`` or ``trusted_ids`` is allowed.
    """
    docs = spread(docs)
    mark = "_trusted_id"
    ids = trusted_ids.select(F.col(id_col).alias(mark)).where(F.col(mark).isNotNull()).distinct()
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # a merge join at every size: texts move once, and nothing that grows is broadcast
    marked = own.join(ids.hint("merge"), F.col("_id") == F.col(mark), "left")
    ratios = log_ratios(marked, F.col(mark).isNotNull(), "_text", buckets)
    table = F.from_json(F.lit("[" + ",".join(map(repr, ratios)) + "]"), "array<double>")

    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counted = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    score = bind(
        ngram_buckets(text, buckets),
        lambda b: F.coalesce(
            F.try_divide(F.aggregate(b, F.lit(0.0), lambda total, x: total + F.get(table, x)), F.size(b)),
            F.lit(0.0),
        ),
    )

    def verdict(c: Column, llr: Column) -> Column:
        failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
        return F.struct(
            c["n_words"].alias("n_words"),
            *[v.alias(k) for k, v in base_measures(text).items()],
            c["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            llr.alias("llr"),
            (~failed & (llr >= threshold)).alias("kept"),
        )

    return docs.withColumn(into, bind(counted, lambda c: bind(score, lambda s: verdict(c, s))))
