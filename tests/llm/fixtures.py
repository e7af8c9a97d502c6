"""Rows with every awkward case the operators define."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators use inside.
CLASHES = ["id", "body", "kept", "keep_id", "node", "key", "quality", "n", "size", "h", "k", "spans", "_id", "score", "length", "word", "start"]


def frame(spark, rows, clashing=True):
    """(doc_id, text[, lang[, source]]) rows as documents, with extra columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHES})
    return df


def words(seed, n, stem="w"):
    import random

    rnd = random.Random(seed)
    return " ".join(f"{stem}{rnd.randrange(500)}" for _ in range(n))
