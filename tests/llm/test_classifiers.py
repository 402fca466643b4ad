"""Held-out accuracy of the trained operators and their defined corner cases."""

import zlib

import numpy as np
import pytest

from conftest import SF01
from vigil.llm import language_id, quality, toxicity
from vigil.llm.catalog import QUERIES
from vigil.llm.ftrl import Ftrl, Rows, softmax, temperature

SF1 = SF01.replace("0.01", "0.1")


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_held_out_accuracy(spark):
    rows = QUERIES["op1_language_id"](spark, SF01).toPandas()
    truth = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").toPandas()
    x = rows.merge(truth, on="doc_id")
    assert len(x) == len(truth) and list(x.held_out) == [is_held_out(i) for i in x.doc_id]
    assert x.score.between(0, 1).all()
    held = x[x.held_out & x.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.98


@pytest.mark.parametrize("name,label,least,cut", [("op2_quality", "quality", 0.98, 0.5),
                                                  ("op7_toxicity", "toxic", 0.94, 0.7)])
def test_label_held_out_accuracy(spark, name, label, least, cut):
    rows = QUERIES[name](spark, SF1).toPandas()
    labels = spark.read.parquet(f"{SF1}/labels.parquet").toPandas()
    n = spark.read.parquet(f"{SF1}/documents.parquet").count()
    assert len(rows) == n and rows.score.between(0, 1).all()
    assert list(rows.held_out) == [is_held_out(i) for i in rows.doc_id]
    assert ((rows.score >= cut).astype(int) == rows.predicted).all()
    x = rows.merge(labels, on="doc_id")
    x = x[x.held_out]
    assert auc(x.score.to_numpy(), x[label].to_numpy()) > least
    if label == "toxic":  # clean documents are left alone
        assert x[x.toxic == 0].predicted.mean() < 0.01 and x[x.toxic == 1].predicted.mean() > 0.5


EDGE = [(1, None, "en"), (2, "", None), (3, "12 34 !!", "en"), (4, "the cat and the dog", "en"),
        (4, "the cat and the dog", "en"), (None, "le chat et le chien", "fr"), (6, "x" * 100_000, None),
        (7, "der hund und die katze", "de")]


def edge(spark):
    return spark.createDataFrame([(*r, "s") for r in EDGE], "doc_id long, text string, lang string, score string")


def test_language_corner_cases(spark):
    docs = edge(spark)
    model = language_id.fit(language_id.training_rows(docs))
    rows = language_id.identify(docs, model, "pred", "p").collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "score", "pred", "p"}
    assert [r.pred for r in rows[:3]] == ["und"] * 3 and [r.p for r in rows[:3]] == [0.0] * 3
    assert rows[3].pred == rows[4].pred and rows[3].p == rows[4].p
    nothing = language_id.fit(language_id.training_rows(docs.limit(0)))
    assert {r.pred for r in language_id.identify(docs, nothing, "pred", "p").collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model, "pred", "p").count() == 0


def test_toxicity_corner_cases(spark):
    docs = edge(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, None), (None, 1), (6, 0)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model, "p").collect()
    assert all(0 <= r.p <= 1 for r in rows) and rows[0].p == rows[1].p and rows[3].p == rows[4].p
    one = toxicity.fit(docs, labels.filter("label = 0"))
    assert all(r.p < 1e-6 for r in toxicity.score(docs, one, "p").collect())
    assert all(r.p < 1e-6 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0)), "p").collect())


def test_quality_corner_cases(spark):
    docs = edge(spark).select("doc_id", "text")
    rows = quality.features(docs)
    none = spark.createDataFrame([], "label int, u double, x binary")
    assert {r.score for r in quality.score(rows, quality.fit(none)).collect()} == {0.5}
    marked = rows.filter("doc_id in (4, 6, 7)").selectExpr("1 as label", "u", "x")
    assert all(r.score > 0.99 for r in quality.score(rows, quality.fit(marked)).collect())
    both = marked.unionByName(rows.filter("doc_id in (1, 2, 3)").selectExpr("0 as label", "u", "x"))
    scores = [r.score for r in quality.score(rows, quality.fit(both)).collect()]
    assert len(scores) == len(EDGE) and all(np.isfinite(scores)) and scores[0] == scores[1]
    assert quality.score(rows.limit(0), quality.fit(both)).count() == 0


def test_validation_sample_takes_few_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(quality, "VALIDATION_ROWS", 200)
    text = (spark.range(2000).selectExpr("concat('copied text ', id) as text")
            .withColumn("u", quality.unit_hash("text")).orderBy("u").first()["text"])
    rows = quality.features(spark.range(2000).selectExpr("id as doc_id", f"'{text}' as text"))
    assert 100 < quality._validation_sample(rows.withColumn("label", rows.doc_id % 2), 2000).count() < 300


def test_statistics_of_extreme_texts():
    for t in (None, "", " \n", "a", "\U0001F600" * 10, "|" * 50_000, "A " * 20_000):
        x = quality.statistics(t)
        assert len(x) == len(quality.FEATURES) and np.isfinite(x).all()


def test_gaussian_density_against_the_formula():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 4))
    cov, mean = np.cov(a.T) + 0.1 * np.eye(4), a.mean(axis=0)
    d = a - mean
    direct = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])
    assert np.allclose(quality.Gaussian(mean, cov).log_density(a), direct)


def test_ftrl_learns_a_sparse_rule():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 500, 30)) for _ in range(600)]
    y = np.array([int((r < 5).any()) for r in rows])
    m = Rows(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows),
             np.ones(sum(map(len, rows))))
    f = Ftrl(500, 2, alpha=1.0, l1=4.0, l2=0.1).fit(m, y, np.ones(600), epochs=6)
    w = f.weights()
    assert ((m.dot(w) + f.bias).argmax(axis=1) == y).mean() > 0.97
    assert (w != 0).any(axis=1).sum() < 250 and (w[:5, 1] > 0).all()


def test_row_subset_and_temperature():
    m = Rows(np.array([0, 2, 2, 3]), np.array([1, 4, 0]), np.array([2.0, 3.0, 5.0]))
    w = np.arange(10.0).reshape(5, 2)
    assert m.dot(w).tolist() == [[28.0, 33.0], [0.0, 0.0], [0.0, 5.0]]
    assert m.take(np.array([2, 1, 0])).dot(w).tolist() == [[0.0, 5.0], [0.0, 0.0], [28.0, 33.0]]
    rng = np.random.default_rng(3)
    true = rng.normal(size=(4000, 2)) * 2
    y = (rng.random(4000) < softmax(true)[:, 1]).astype(int)
    assert abs(temperature(true * 3, y, np.ones(4000)) - 3) < 0.4
