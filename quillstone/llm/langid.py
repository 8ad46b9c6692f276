"""Language identification by words, backing off to character n-grams.

A word that the model knows scores its smoothed log frequency in each language. A word it does not know scores the mean
log frequency of its longest character n-grams (``longest`` down to 1, word ends marked) of which the model knows any.
The language with the largest sum over the whole text wins; the score is its posterior under equal priors.

The model is learned from a bounded sample: up to ``max_docs`` documents of each language by hash order, whole texts,
counted in Spark; the most frequent ``max_words`` words and ``max_grams`` n-grams of each length and language are kept.
It is broadcast: at most languages * (max_words + longest * max_grams) entries. Predicting is one pass over the texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal texts get equal results; null
languages and null ids are not learned from; if nothing is learned every text is ``und``; an empty table gives an empty
result. All columns of the input are kept; columns with the names of the results are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.arrow_text import slices

_WORD = re.compile(r"[^\W\d_]+")
MOST_WORDS = 300_000  #: scored words that a worker keeps


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Model(NamedTuple):
    name: str
    languages: list[str]
    words: dict[str, int]  #: row of the table
    grams: dict[str, int]
    table: np.ndarray  #: log frequency by language


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        counts: dict[str, Counter] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text or ""))
        yield _rows((lang, 0, w, n) for lang, c in counts.items() for w, n in c.items())


def _cut(longest: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n")), strict=True):
                for k in range(1, longest + 1):
                    for gram in grams_of(word, k):
                        counts[lang, k, gram] += n
            yield _rows((*key, n) for key, n in counts.items())

    return cut


def _rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "size", "item", "n"]
    )


ROWS = "lang string, size int, item string, n long"


def learn_languages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_docs: int = 1000,
    max_words: int = 10_000,
    max_grams: int = 5_000,
    longest: int = 4,
) -> Model:
    """Model of the labelled documents; sizes (0 for words) and counts are taken in Spark."""
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"))
    by_hash = W.partitionBy("lang").orderBy(F.xxhash64("k"), "k")
    sample = known.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= max_docs).select("k", "lang").distinct()
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(
        F.broadcast(sample), ["k", "lang"]  # max_docs rows of each language
    )
    words = rows.select("lang", "text").mapInArrow(_counted, ROWS).groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    words = words.persist()
    grams = words.mapInArrow(_cut(longest), ROWS).groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    totals = F.sum("n").over(W.partitionBy("lang", "size"))
    first = F.row_number().over(W.partitionBy("lang", "size").orderBy(F.desc("n"), "item"))
    keep = F.when(F.col("size") == 0, max_words).otherwise(max_grams)
    top = words.unionByName(grams).withColumns({"total": totals, "r": first}).where(F.col("r") <= keep)
    pdf = top.select("lang", "size", "item", "n", "total").toPandas()
    words.unpersist()
    return _model(pdf)


def _model(pdf) -> Model:
    languages = sorted(pdf["lang"].unique())
    place = {name: i for i, name in enumerate(languages)}
    total = np.ones((int(pdf["size"].max()) + 1 if len(pdf) else 1, len(languages)))
    total[pdf["size"], pdf["lang"].map(place)] = pdf["total"]
    keys = pdf["size"].astype(str) + pdf["item"]
    rows = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    counts, sizes = np.zeros((len(rows), len(languages))), np.zeros(len(rows), int)
    at = keys.map(rows).to_numpy(int)
    counts[at, pdf["lang"].map(place)] = pdf["n"]
    sizes[at] = pdf["size"]
    table = np.log((counts + 0.1) / (total[sizes] + 1.0))
    words = {k[1:]: i for k, i in rows.items() if k[0] == "0"}
    return Model(uuid.uuid4().hex, languages, words, {k[1:]: i for k, i in rows.items() if k[0] != "0"}, table)


class Scorer:
    """Rows of log frequencies for words as they come, kept up to a bounded number."""

    def __init__(self, model: Model):
        self.model = model
        self.longest = max((len(g) for g in model.grams), default=1)
        self.start()

    def start(self) -> None:
        self.rows = dict(self.model.words)
        self.table = np.vstack([self.model.table, np.zeros((1024, len(self.model.languages)))])
        self.used = len(self.model.table)

    def learn(self, word: str) -> int:
        grams = self.model.grams
        found: list[int] = []
        for n in range(min(self.longest, len(word) + 2), 0, -1):
            found = [grams[g] for g in grams_of(word, n) if g in grams]
            if found:
                break
        if self.used == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        if found:
            self.table[self.used] = self.model.table[found].mean(0)
        self.rows[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not self.model.languages or not any(any(map(str.isalpha, w)) for w in words):
            return "und", 0.0
        if len(self.rows) > MOST_WORDS:
            self.start()
        get, learn = self.rows.get, self.learn
        at = [i if (i := get(w)) is not None else learn(w) for w in words]
        sums = self.table[at].sum(0)
        best = int(np.argmax(sums))
        return self.model.languages[best], float(1 / np.exp(np.clip(sums - sums[best], -700, 0)).sum())


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with the language of their whole text and its probability."""
    kept = docs.drop(lang_pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model.name not in _scorers:
            _scorers.clear()
            _scorers[model.name] = Scorer(model)
        scorer = _scorers[model.name]
        for part in slices(batches, text):
            found = [scorer.predict(t) for t in part.column(text).to_pylist()]
            columns = [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, lang_pred, score])

    fields = [*kept.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]
    return kept.mapInArrow(predicted, T.StructType(fields))
