import os

import corpus_pipeline as P
from pyspark.sql import functions as F

from tessera.llm import queries as Q

from .fixtures import DOCS, frame, words
from .test_near_dedup import brute as components
from .test_near_dedup import mutate
from .test_quality_rules import brute as measures


def make(spark, folder):
    import random

    rnd = random.Random(8)
    clean = [(k, words(k, 70 + k), "en", f"s{k % 4}") for k in range(60)]
    copies = [(100 + k, clean[k][1].upper() if k % 2 else clean[k][1], "en", "s9") for k in range(10)]
    near = [(200 + k, mutate(clean[20 + k][1], rnd, 1), "en", None) for k in range(10)]
    bad = [(300, "short", "en", "s0"), (301, None, "en", "s0"), (302, "x " * 300, "en", "s0")]
    rows = clean + copies + near + bad + [clean[5]]
    spark.createDataFrame([(*r, None) for r in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    rows = make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = [r for r in rows if not measures(r[1])[-1]]
    for k, (_, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        if k < 4:
            assert docs.columns == DOCS.names
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if k == 0:
            assert ids == sorted(r[0] for r in expected)
        elif k == 1:
            least = {}
            for r in expected:
                least[r[1].lower()] = min(least.get(r[1].lower(), r[0]), r[0])
            expected = list({r[0]: r for r in expected if least[r[1].lower()] == r[0]}.values())
            assert ids == sorted(r[0] for r in expected)
        elif k == 2:
            found = components([(r[0], r[1]) for r in expected])
            expected = [r for r in expected if found[r[0]][1] == r[0]]
            assert ids == sorted(r[0] for r in expected)
        elif k == 3:
            taken = {r.doc_id: r.taken // r.size for r in Q.mix_sources(before).collect()}
            assert ids == sorted(i for i, n in taken.items() for _ in range(n)) and len(ids) > len(set(ids))
        else:
            assert docs.where("length > 1024").count() == 0
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
            assert set(ids) == {r.doc_id for r in before.select("doc_id").collect()}
    assert P.run(spark, folder).count() == docs.count()


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    assert P.run(spark, folder).count() == 0
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    for name, query in Q.queries().items():
        assert query(spark, folder).count() == (1 if name.startswith("op4") else 0), name


def test_one_query_an_operator():
    names = sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert os.path.basename(P.__file__) == "corpus_pipeline.py"


def test_extra_columns_are_no_matter(spark, tmp_path):
    clash = frame(spark, [(1, words(1, 80)), (2, words(1, 80)), (3, None)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    judged = P.quality_stage(spark, clash, str(tmp_path))
    assert judged.columns == clash.columns and {r.doc_id for r in judged.select("doc_id").collect()} == {1, 2}
    assert {r.doc_id for r in P.packing_stage(spark, clash, "").select("doc_id").collect()} == {1, 2, 3}
    assert P.exact_stage(spark, clash, "").count() == 2
    assert P.near_stage(spark, clash, "").count() == 2
    assert P.mixing_stage(spark, clash, "").columns == clash.columns


def test_mixing_takes_rows_of_one_id_twice_at_most(spark):
    docs = frame(spark, [(k, words(k, 40), "en", "ab"[k % 2]) for k in range(40)] + [(k, words(900 + k, 40), "en", "ba"[k % 2]) for k in range(40)])
    got = P.mixing_stage(spark, docs, "")
    assert got.groupBy("doc_id", "text").count().where("count > 2").count() == 0


def test_near_stage_tells_rows_of_one_id_apart(spark):
    import random

    base = words(3, 90)
    docs = frame(spark, [(1, base), (2, mutate(base, random.Random(1), 1)), (2, words(70, 90)), (None, words(71, 90)), (5, None)])
    got = {(r.doc_id, r.text) for r in P.near_stage(spark, docs, "").select("doc_id", "text").collect()}
    assert got == {(1, base), (2, words(70, 90)), (None, words(71, 90)), (5, None)}


def test_copies_are_numbered(spark):
    docs = frame(spark, [(1, words(1, 2_000)), (1, words(1, 2_000)), (2, "x"), (None, None)])
    got = P.packing_stage(spark, docs, "").select("doc_id", "piece", "copy").collect()
    pieces = {r.piece for r in got if r.doc_id == 1}
    assert sorted((r.piece, r.copy) for r in got if r.doc_id == 1) == [(p, c) for p in sorted(pieces) for c in (1, 2)]
    assert [(r.piece, r.copy) for r in got if r.doc_id != 1] == [(0, 1), (0, 1)]
