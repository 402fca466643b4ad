"""Toxicity (operator 7): FTRL-proximal logistic regression over hashed word
n-grams and skip-grams.

A document's features are its distinct words, word pairs and pairs with one
word between them, hashed to 2^18 places, half of them for the words; a pair
has half a word's value, as most pairs are chance. Rates are per coordinate and the L1
penalty leaves few weights, which are broadcast as (place, weight) pairs. The
learner sees at most ``per_class`` labelled documents of each class (whole
texts, chosen by a hash of the row), weighted so that the classes count as they
do among all labelled documents; the scores are therefore probabilities. A
fifth of them sets a temperature, before the weights are fitted on all.

Defined results: an empty or null text has no features and scores the bias
alone; without rows to learn from, or with one class only, every score is the
share of label 1 (0 without rows). Rows with a null label or a null
``doc_id`` are not learnt from; a ``doc_id`` with several labels is learnt from
once for each. Equal texts get equal scores. Extra columns are kept by
:func:`score`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import chunks, held_out, in_task, task, unit_hash
from vigil.llm.ftrl import Ftrl, Rows, temperature, unpacked

BITS = 18
DIMS = 1 << BITS
HALF = DIMS // 2   # words below, pairs above
PAIR_VALUE = 0.5
PER_CLASS = 4000
CUT = 0.7

# ASCII other than letters and digits separates words; other bytes are letters.
_SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Words(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def grams(text: str | None, words: Words) -> np.ndarray:
    """Places of the words, pairs and skip-pairs, repeated as they occur."""
    tokens = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATE).split()
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    parts = [h * _K[0], (h[:-1] * _K[1] + h[1:]) * _K[0], (h[:-2] * _K[2] + h[2:]) * _K[3]]
    places = (np.concatenate(parts) >> np.uint64(65 - BITS)).astype(np.int64)
    places[len(h):] += HALF
    return places


def _features(sample: DataFrame) -> pa.Table:
    @in_task("toxicity")
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start, texts in chunks(batch.column(2)):
                idx = [np.unique(grams(t, words)).astype("<i4").tobytes() for t in texts]
                k = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, k), batch.column(1).slice(start, k),
                     pa.array(idx, pa.binary())], names=["label", "u", "idx"])

    return sample.select("label", "u", "text").mapInArrow(make, "label int, u double, idx binary").toArrow()


class Model:
    """The non-zero weights by place, the bias and the temperature."""

    def __init__(self, place: np.ndarray, weight: np.ndarray, bias: float, temp: float):
        self.place, self.weight, self.bias, self.temp = place, weight, bias, temp
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def score(self, text: str | None, words: Words) -> float:
        if self._dense is None:
            self._dense = np.zeros(DIMS, np.float32)
            self._dense[self.place] = self.weight
        g = grams(text, words)
        g = np.unique(g[self._dense[g] != 0])  # a feature counts once
        logit = (float(self._dense[g].sum(dtype=np.float64)) + self.bias) / self.temp
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def _learner() -> Ftrl:
    return Ftrl(DIMS, 2, alpha=3.0, l1=5.0, l2=0.1)


def _constant(share: float) -> Model:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))), 1.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from the texts of ``docs`` (doc_id, text) that ``labels``
    (doc_id, label) marks 0 or 1.

    The sample is drawn from the labels: about ``per_class`` distinct ids of
    each class, few enough to be broadcast to the scan of the texts.
    """
    marked = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return _constant(sizes.get(1, 0) / max(total, 1))
    limit = F.when(F.col("label") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0])
    picked = marked.withColumn("u", unit_hash(F.col("doc_id"), F.col("label"))).filter(F.col("u") < limit)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = _features(sample)
    labels, u = rows["label"].to_numpy().astype(int), rows["u"].to_numpy()
    ptr, idx = unpacked(rows["idx"])
    matrix = Rows(ptr, idx, np.where(idx < HALF, 1.0, PAIR_VALUE).astype(np.float32))
    taken = np.bincount(labels, minlength=2)
    if taken.min() == 0:
        return _constant(sizes[1] / total)
    weight = np.array([sizes[c] / total * len(labels) / taken[c] for c in (0, 1)])[labels]
    order = np.lexsort((u, labels))  # by the hash, so that the order of tasks plays no part
    held, fitted = order[4::5], np.delete(order, np.s_[4::5])
    first = _learner().fit(matrix, labels, weight, epochs=6, subset=fitted)
    temp = temperature(matrix.take(held).dot(first.weights()) + first.bias, labels[held], weight[held])
    # The temperature is known; the weights are then fitted on all rows.
    learner = _learner().fit(matrix, labels, weight, epochs=6, subset=order)
    w = learner.weights()
    diff = w[:, 1] - w[:, 0]
    diff[HALF:] *= PAIR_VALUE
    place = np.flatnonzero(diff)
    return Model(place, diff[place].astype(np.float32), float(learner.bias[1] - learner.bias[0]), temp)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of ``text`` in ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with task("toxicity"):
            words, m = Words(), shared.value
            for texts in batches:
                yield pd.Series([m.score(t, words) for t in texts], dtype=float)

    return docs.withColumn(out, predict(F.col("text")))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of documents that are not held out."""
    return labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, training_labels(labels, "toxic"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
