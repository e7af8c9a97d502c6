"""The corpus pipeline: quality rules, exact dedup, near dedup, source mixing, packing.

Each stage takes all that its predecessor kept, calls one operator of ``tessera.llm``, and
lets its decisions take effect. All but the last return the columns of ``documents``, and
keep extra columns out of the way of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import fresh, materialise, table
from tessera.llm.exact_dedup import exact_owners
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality_rules import quality_rules

#: No SQL gives the hashed n-gram, near-duplicate, mixing and packing decisions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those labelled 1 are the trusted target.

    Null, empty and short texts fail the base rules and go; very long ones are judged whole.
    Repeated rows and rows that tie get one verdict, null ids are trusted by nobody, and an
    empty table stays empty.
    """
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    into = fresh(docs, "quality")
    judged = quality_rules(docs, trusted, into=into)
    return judged.where(F.col(f"{into}.kept")).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, the one with the smallest id; of those that repeat id and text, one.

    Rows are told apart by id and text, so rows that share only an id are judged each by its
    own text. Null and empty texts are equal, and a null id stays only where no other is.
    Very long texts are compared whole; an empty table stays empty.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digest = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), upper, lower), 256)
    mine, sha = fresh(docs, "kept_id"), fresh(docs, "kept_sha")
    kept = exact_owners(docs, owner="smallest").where("kept").select(F.col("doc_id").alias(mine), F.col("text_sha256").alias(sha))
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(mine)) & (digest == F.col(sha)), "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    return left.withColumn(sha, digest).dropDuplicates(["doc_id", sha]).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows are told apart by id and text: of rows that share an id, each is judged by its own
    text, and of equal ids the smaller text hash stays. Null, empty and wordless texts stay,
    null ids come first; very long texts are compared whole; an empty table stays empty.
    """
    row = fresh(docs, "row_key")
    keyed = docs.withColumn(row, F.struct(F.col("doc_id"), F.xxhash64("text").alias("text")))
    kept = near_duplicates(keyed, id_col=row).where("kept").select(row)
    return keyed.join(kept, row, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is two rows from here on, and one it doesn't take goes.

    Null and empty texts have no words, so the mix takes none of them; a null source is a
    source. Rows that share an id are taken as often as the one taken most. Very long texts
    are taken whole or not at all; rows that tie are taken in seeded order, then by id; an
    empty table stays empty.
    """
    mine, copies, copy = fresh(docs, "taken_id"), fresh(docs, "copies"), fresh(docs, "copy")
    mixed = mix_sources(docs).where("taken > 0").select(F.col("doc_id").alias(mine), F.expr("taken div size").cast("int").alias(copies))
    taken = mixed.groupBy(mine).agg(F.max(copies).alias(copies))  # rows that share an id are taken alike, so no id multiplies its rows
    chosen = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(mine)))
    return chosen.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of :func:`pack_documents`, and ``copy``, counted from 1: which of the equal pieces of a document taken twice it is.

    Null and empty texts pack their end id; very long ones are cut into many pieces. Rows
    that repeat an id and a text are copies of each other, in the order of their sequences;
    null ids are packed like others; an empty table has no pieces.
    """
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    alike = Window.partitionBy("doc_id", "piece", "start", "length", "ids_crc32").orderBy("sequence_id", "offset")
    return pieces.withColumn("copy", F.row_number().over(alike))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
