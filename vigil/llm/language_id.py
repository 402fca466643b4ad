"""Language identification (operator 1): sparse multinomial logistic regression
on TF-IDF character n-grams, trained by FTRL with an elastic net, then
calibrated by a temperature.

Features are the hashed 1- to 3-grams of the lower-cased text in which every
run-breaking character (not a letter) counts as a space. A feature's value is
its share of the text's n-grams times its inverse document frequency, so a
score is one weighted sum over the text's n-grams and needs no grouping. The
document frequencies are counted over all training documents. The weights are
fitted on at most ``per_language`` documents of each language (whole texts,
chosen by a hash of the row), a fifth of which sets the temperature.

Defined results: ``und`` with score 0 where the text is null, empty or has no
letter, or when there is nothing to learn from (no training document with a
language and a letter). With a single known language its score is 1. Rows with
a null ``lang`` or ``doc_id`` are scored and a null ``lang`` is not learnt from.
Equal texts get equal results. Extra columns are kept by :func:`identify`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import chunks, held_out, in_task, task, unit_hash, unused
from vigil.llm.ftrl import Ftrl, Rows, softmax, temperature, unpacked

BITS = 16
DIMS = 1 << BITS
PER_LANGUAGE = 1500
UNKNOWN = "und"
SCALE = 100.0  # keeps the features' values near 1

_MULT = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space. Above the first
    plane every code point counts as it is."""
    table = np.arange(0x110000, dtype=np.uint32)
    low = np.array([chr(c).isalpha() for c in range(0x10000)])
    table[:0x10000][~low] = 32
    return table


_TABLE: list[np.ndarray] = []


def ngrams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, in order, repeated as they occur; none if the
    text has no letter."""
    if not text:
        return np.empty(0, np.int64)
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = _TABLE[0][points]
    if not any(map(str.isalpha, text)):
        return np.empty(0, np.int64)
    c = np.concatenate([np.array([32], np.uint32), c, np.array([32], np.uint32)])
    # Runs of spaces count once, so that layout and junk weigh little.
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    shift = np.uint32(32 - BITS)
    out, acc = [], np.zeros(len(c), np.uint32)
    for n in range(3):
        acc = acc[:len(c) - n] * _MULT[1] + (c[n:] + np.uint32(n)) * _MULT[0]
        h = (acc ^ (acc >> np.uint32(15))) * _MULT[2]
        out.append((h >> shift).astype(np.int64))
    return np.concatenate(out)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that have each feature, documents with a letter) over all rows
    of ``texts``. A task sends one row per feature, Spark adds them up."""

    @in_task("language")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, seen = np.zeros(DIMS, np.int64), 0, np.zeros(DIMS, bool)
        for batch in batches:
            for t in batch.column(0):
                g = ngrams(t.as_py())
                if len(g):
                    seen[g] = True
                    df += seen
                    seen[:] = False
                    docs += 1
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(have, -1), pa.int32()), pa.array(np.append(df[have], docs), pa.int64())],
            names=["feature", "df"])

    rows = (texts.select("text").mapInArrow(count, "feature int, df long")
            .groupBy("feature").agg(F.sum("df").alias("df")).toPandas())
    out = np.zeros(DIMS, np.int64)
    feature, df = rows["feature"].to_numpy(), rows["df"].to_numpy()
    real = feature >= 0
    out[feature[real]] = df[real]
    return out, int(df[~real].sum())


def _sample(train: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, by a row hash. A model holds
    2^16 weights per language, so their counts fit the driver."""
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train.select("lang", "text", F.lit(0.0).alias("u"))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, per_language / n)])
    return (train.withColumn("u", unit_hash(F.col("doc_id"), F.col("text")))
            .filter(F.col("u") < share[F.col("lang")]).select("lang", "text", "u"))


def _sample_counts(sample: DataFrame) -> pa.Table:
    @in_task("language")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column(1)):
                idx, num = [], []
                for t in texts:
                    f, c = np.unique(ngrams(t), return_counts=True)
                    idx.append(f.astype("<i4").tobytes())
                    num.append(c.astype("<i4").tobytes())
                k = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, k), batch.column(2).slice(start, k),
                     pa.array(idx, pa.binary()), pa.array(num, pa.binary())],
                    names=["lang", "u", "idx", "num"])

    return sample.mapInArrow(count, "lang string, u double, idx binary, num binary").toArrow()


class Model:
    """Languages, the table (feature, language) of weights times idf, the bias
    and the temperature."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temp: float):
        self.langs, self.table, self.bias, self.temp = langs, table, bias, temp

    def predict(self, text: str | None) -> tuple[str, float]:
        g = ngrams(text)
        if not len(g) or not self.langs:
            return UNKNOWN, 0.0
        if len(g) > DIMS:
            total = np.bincount(g, minlength=DIMS) @ self.table
        else:
            total = self.table[g].sum(axis=0)
        logits = (total / len(g) + self.bias) / self.temp
        p = softmax(logits[None, :])[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows (doc_id, text, lang) with a non-null lang."""
    df, docs = document_frequencies(train)
    rows = _sample_counts(_sample(train, per_language).filter(F.length("text") > 0))
    ptr, idx = unpacked(rows["idx"])
    size = ptr[1:] - ptr[:-1]
    lang, u = rows["lang"].to_numpy(zero_copy_only=False), rows["u"].to_numpy()
    langs = sorted(set(lang[size > 0]))
    if not langs:
        return Model([], np.zeros((DIMS, 0)), np.zeros(0), 1.0)
    idf = np.log((1 + docs) / (1 + df)) + 1
    num = unpacked(rows["num"])[1].astype(np.float32)
    sums = np.concatenate([[0.0], np.cumsum(num, dtype=np.float64)])
    num /= np.repeat(np.maximum(sums[ptr[1:]] - sums[ptr[:-1]], 1), size)
    matrix = Rows(ptr, idx, num * (idf * SCALE).astype(np.float32)[idx])
    labels = np.searchsorted(langs, lang)
    order = np.lexsort((u, lang))  # by the hash, so that the order of tasks plays no part
    order = order[size[order] > 0]
    held, fitted = order[4::5], np.delete(order, np.s_[4::5])
    weight = np.ones(len(labels))
    learner = Ftrl(DIMS, len(langs), alpha=0.2, l1=0.5, l2=0.1)
    learner.fit(matrix, labels, weight, subset=fitted)
    w = learner.weights()
    temp = temperature(matrix.take(held).dot(w) + learner.bias, labels[held], weight[held])
    table = (w * (idf * SCALE)[:, None]).astype(np.float32)
    return Model(langs, table, learner.bias, temp)


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of ``text`` and its probability. The
    broadcast model has 2^16 weights per language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with task("language"):
            m = shared.value
            for texts in batches:
                yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang", "score"])

    (tmp,) = unused(docs, "lid")
    own = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(tmp, predict(F.col("text"))).select(
        *own, F.col(f"{tmp}.lang").alias(lang), F.col(f"{tmp}.score").alias(score))


def training_rows(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """Rows to learn from: a known language, and not held out."""
    held = held_out(F.col("doc_id")) if held is None else held
    return docs.filter(F.col("lang").isNotNull() & ~held).select("doc_id", "text", "lang")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
