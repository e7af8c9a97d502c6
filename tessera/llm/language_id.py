"""Language identification, words first.

A word that training has seen is scored by its log frequency in each language. An unseen
word backs off to the longest character n-grams of it that training has seen, five
characters first and one last. A text's languages are compared by the sum over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, spread

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: tuple[dict[str, int], ...]
    gram_scores: tuple[np.ndarray, ...]


def _marked(word: str) -> str:
    return f"^{word}$"


def fit_language_model(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = 1_000,
    least_word_count: int = 2,
    least_gram_count: int = 3,
    smoothing: float = 0.5,
    model_bytes: int = 256 << 20,
) -> LanguageModel:
    """Fit on a bounded sample: about ``docs_per_language`` rows of each language, by hash of the id.

    Only rows where ``training`` holds, and whose text and language aren't null, are used;
    whole texts count, very long ones too. Tables of scores take ``model_bytes`` at most:
    where more words or n-grams of a length were seen, the most frequent stay, and of equally
    frequent ones the first by name. So the model may travel to every task. Rows that repeat
    an id are sampled alike; null ids are an id.
    """
    pool = docs.where(training).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).cast("string").alias("language")).where(
        "body IS NOT NULL AND language IS NOT NULL"
    )
    share = [(r["language"], min(1.0, docs_per_language / r["n"])) for r in pool.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()]
    languages = tuple(sorted(name for name, _ in share))
    if not languages:
        return LanguageModel((), {}, np.zeros((0, 0)), ({},) * LONGEST, (np.zeros((0, 0)),) * LONGEST)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(share, "language string, share double"))  # one row a language
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(29)), F.lit(1_000_000)) / 1_000_000.0
    sample = pool.join(wanted, "language").where(place < F.col("share")).select("language", "body")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(language, Counter()).update(LETTERS.findall(body.lower()))
        for language, found in words.items():
            tables: list[Counter] = [Counter() for _ in range(LONGEST + 1)]
            tables[0] = found
            for word, n in found.items():
                m = _marked(word)
                for size in range(1, LONGEST + 1):
                    for at in range(len(m) - size + 1):
                        tables[size][m[at : at + size]] += n
            for size, table in enumerate(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(table)), pa.array([size] * len(table), pa.int32()), pa.array(list(table)), pa.array(list(table.values()), pa.int64())],
                    names=["language", "size", "gram", "n"],
                )

    least = F.when(F.col("size") == 0, F.lit(least_word_count)).otherwise(F.lit(least_gram_count))
    counts = (
        sample.mapInArrow(count, "language string, size int, gram string, n long")
        .groupBy("language", "size", "gram")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
    )
    most = max(1, model_bytes // (8 * len(languages) * (LONGEST + 1)))
    counts = materialise(counts, "grams")
    totals = counts.groupBy("size", "gram").agg(F.sum("n").alias("total"))
    crowded = [r["size"] for r in totals.groupBy("size").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).collect()]  # six rows at most
    for size in crowded:
        chosen = totals.where(F.col("size") == size).orderBy(F.desc("total"), "gram").limit(most).select("size", "gram")
        counts = counts.where(F.col("size") != size).unionByName(counts.where(F.col("size") == size).join(chosen, ["size", "gram"], "left_semi").select(*counts.columns))
    at = {name: k for k, name in enumerate(languages)}
    vocab: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    cells: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in range(LONGEST + 1)]
    for language, size, gram, n in counts.toArrow().to_pandas().sort_values(["size", "gram", "language"])[["language", "size", "gram", "n"]].itertuples(index=False):
        row = vocab[size].setdefault(gram, len(vocab[size]))
        for col, v in zip(cells[size], (row, at[language], n), strict=True):
            col.append(v)

    def scores(size: int) -> np.ndarray:
        table = np.zeros((len(vocab[size]), len(languages)))
        table[cells[size][0], cells[size][1]] = cells[size][2]
        total = table.sum(0) + smoothing * (len(table) + 1)
        return np.log((table + smoothing) / total)

    return LanguageModel(languages, vocab[0], scores(0), tuple(vocab[1:]), tuple(scores(k) for k in range(1, LONGEST + 1)))


class _Scorer:
    """Log scores of words, each computed once as long as it is remembered: in ``memory_bytes`` at most, whatever the number of languages."""

    def __init__(self, model: LanguageModel, memory_bytes: int = 64 << 20) -> None:
        self.model, self.remember = model, max(8, memory_bytes // (8 * len(model.languages) + 120))
        self.forget()

    def forget(self) -> None:
        known = len(self.model.words)
        self.row = dict(self.model.words)
        self.table = np.zeros((known + self.remember, len(self.model.languages)))
        self.table[:known] = self.model.word_scores
        self.used = known

    def unseen(self, word: str) -> np.ndarray:
        m = _marked(word)
        for size in range(LONGEST, 0, -1):
            known = self.model.grams[size - 1]
            rows = [known[g] for g in (m[a : a + size] for a in range(len(m) - size + 1)) if g in known and g not in "^$"]
            if rows:
                return self.model.gram_scores[size - 1][rows].mean(0)
        return np.zeros(len(self.model.languages))

    def of(self, words: list[str]) -> np.ndarray:
        row, out = self.row, []
        for w in words:
            k = row.get(w)
            if k is None:
                if self.used == len(self.table):
                    total = self.table[out].sum(0) if out else 0
                    self.forget()
                    return total + self.of(words[len(out) :])
                k = row[w] = self.used
                self.table[k] = self.unseen(w)
                self.used += 1
            out.append(k)
        return self.table[out].sum(0)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred and score, one row for each row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learnt.
    The score is the predicted language's share of the likelihood, all languages being
    equally likely beforehand; of equal languages the first by name is predicted. Very long
    texts count whole, in bounded memory. Repeated rows and null ids are kept, other columns,
    whatever their names, aren't read, and an empty table gives an empty result.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")))
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value) if shared.value.languages else None
        for batch in batches:
            names, scores = [], []
            for value in batch.column(1):
                body = value.as_py()
                words = LETTERS.findall(body.lower()) if body and scorer else []
                if not any(any(map(str.isalpha, w)) for w in words):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = scorer.of(words)
                best = int(total.argmax())
                names.append(scorer.model.languages[best])
                scores.append(float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(identify, schema).select(F.col("id").alias(id_col), "lang_pred", "score")
