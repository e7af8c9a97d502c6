"""Definitions of many terms in many texts, against every pair of them."""

import random

from pyspark.sql import functions as F

from tessera.operators.phrases import define, definitions, phrase_index


def test_definitions_are_those_of_all_pairs(spark):
    rnd = random.Random(9)
    words = ["a", "Fee", "fee", "net fee", "Größe", "GRÖSSE", "größe", "x_1", "c++", "means", "is", "the net fee of a year", "the", "year", "漢字"]
    bits = [*words, " means ", " MEANS\t", ": ", ":", " : ", "::", " is  defined as ", "\nis just ", " refers  to ", " = ", " == ", "=", ". ", "\n", ", ", " ", "\x01", "-", "some text here"]
    texts = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25)))) for k in range(400)] + [(998, ""), (999, None)]
    texts += [(1_000, "a b c d e f means g h"), (1_001, "net  fee means no"), (1_002, "Net fee is just: the fee = two"), (1_003, "fee= means: = : = one two")]
    t = spark.createDataFrame(texts, "id long, text string")
    terms = spark.createDataFrame([(w,) for w in [*words, "b c d e f", "fee is just", "f", "Fee of", "+", "a"]], "term string")
    pairs = t.crossJoin(terms.distinct().where(F.rlike("term", F.lit(r"[\p{L}\p{N}_]")))).select("id", "term", F.explode(definitions(F.col("text"), F.col("term"))).alias("value"))
    want = sorted(map(tuple, pairs.collect()))
    assert len(want) > 300 and sorted(map(tuple, define(t, terms).collect())) == want


def test_a_frequent_word_that_nothing_is_said_of_finds_nothing(spark):
    texts = spark.range(200).selectExpr("id", "concat('The fee of the year ', id, ' is known. Term', id, ' means number ', id) AS text")
    terms = spark.sql("SELECT explode(array('the', 'fee', 'year', 'of the', 'Term7', 'is known')) AS term")
    assert [tuple(r) for r in phrase_index(texts, terms).collect()] == [(7, "Term7")]
