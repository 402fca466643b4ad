"""Quality classifier (operator 2): regularised quadratic discriminant analysis
of transformed document statistics.

Each document is described by :data:`FEATURES`, all from its whole text. The
class means and second moments are sums over all labelled training documents,
added up by Spark; a class covariance is shrunk towards the pooled one and that
towards a multiple of the identity, with the shrinkage that gives the least log
loss on a fifth of the rows kept for it. The score is the difference of two
Mahalanobis log-densities plus the log prior odds, passed through a fitted
slope and offset; the Cholesky factors of the covariances are computed once and
broadcast.

Defined results: a null or empty text has the statistics of the empty text and
a score; without rows to learn from the score is 0.5, with one class only that
class's label. Rows with a null label or ``doc_id`` are not learnt from. Equal
texts get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import chunks, held_out, in_task, materialise, unit_hash

FEATURES = (
    "log_chars", "log_words", "log_lines", "word_length", "upper", "digit", "space", "symbol",
    "bar", "sentence_end", "comma", "non_ascii", "letter_entropy", "distinct_words",
    "doubled_words", "repeated_pairs", "long_words", "short_words", "symbol_words", "upper_words",
    "line_repeats", "line_length")

_B = np.arange(256)
_CLASS = {
    "upper": (_B >= 65) & (_B <= 90), "lower": (_B >= 97) & (_B <= 122), "digit": (_B >= 48) & (_B <= 57),
    "space": (_B == 32) | ((_B >= 9) & (_B <= 13)), "bar": _B == 124,
    "sentence_end": np.isin(_B, [33, 46, 63]), "comma": np.isin(_B, [44, 58, 59]), "high": _B >= 128,
    "lead": (_B >= 128) & (_B < 192),
}
_SYMBOL = ~(_CLASS["upper"] | _CLASS["lower"] | _CLASS["digit"] | _CLASS["space"] | _CLASS["high"]
            | _CLASS["sentence_end"] | _CLASS["comma"] | _CLASS["bar"])
_SYMBOL_BYTES = bytes(np.flatnonzero(_SYMBOL | _CLASS["bar"]).astype(np.uint8))


def _logit(x: float) -> float:
    """A share, spread out at both ends."""
    return float(np.log((x + 0.002) / (1.002 - x)))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    share = {k: float(hist[m].sum()) / n for k, m in _CLASS.items()}
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    k, m = max(len(words), 1), max(len(lines), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = (hist[65:91] + hist[97:123]).astype(float)
    p = letters[letters > 0] / max(letters.sum(), 1)
    symbols = sum(w != w.strip(_SYMBOL_BYTES) for w in words)
    uppers = sum(map(bytes.isupper, words))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)),
        np.log1p(float(sizes.sum()) / k), _logit(share["upper"]), _logit(share["digit"]),
        _logit(share["space"]), _logit(float(hist[_SYMBOL].sum()) / n), _logit(share["bar"]),
        _logit(share["sentence_end"]), _logit(share["comma"]), _logit(share["high"]),
        float(-(p * np.log(p)).sum()), _logit(len(set(words)) / k),
        _logit(sum(map(eq, words, words[1:])) / k),
        _logit(1 - len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)) if len(words) > 1 else _logit(0.0),
        _logit(float((sizes > 12).sum()) / k), _logit(float((sizes < 3).sum()) / k),
        _logit(symbols / k), _logit(uppers / k),
        _logit(1 - len(set(lines)) / m) if lines else _logit(0.0), np.log1p(len(raw) / m)]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, u, s, x`` of every row (doc_id, text); ``u`` and ``s`` are hashes
    in [0, 1) of the text, and of the id and the text."""

    @in_task("quality")
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column(3)):
                x = np.array([statistics(t) for t in texts], "<f8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)),
                     batch.column(2).slice(start, len(texts)), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["doc_id", "u", "s", "x"])

    return docs.select("doc_id", unit_hash(F.col("text")).alias("u"),
                       unit_hash(F.col("doc_id"), F.col("text")).alias("s"), "text").mapInArrow(
        make, "doc_id long, u double, s double, x binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, len(FEATURES))


def _moments(rows: DataFrame) -> dict[tuple[bool, int], tuple[float, np.ndarray, np.ndarray]]:
    """(validation, label) -> count, sum and sum of outer products, from one
    row per task and group. Rows are (label, u, x)."""
    d = len(FEATURES)

    @in_task("quality")
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column("x"))
            x = np.hstack([np.ones((len(x), 1)), x])
            label = batch.column("label").to_numpy()
            val = batch.column("u").to_numpy() < VALIDATION
            for v in (False, True):
                for c in (0, 1):
                    part = x[(label == c) & (val == v)]
                    if len(part):
                        total[v, c] = total.get((v, c), 0) + part.T @ part
        for (v, c), m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * m.size), pa.array([c] * m.size, pa.int32()),
                 pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())],
                names=["val", "label", "at", "v"])

    out = (rows.mapInArrow(add, "val boolean, label int, at int, v double")
           .groupBy("val", "label", "at").agg(F.sum("v").alias("v")).toPandas())
    result = {}
    for (v, c), part in out.groupby(["val", "label"]):
        m = np.zeros((d + 1) ** 2)
        m[part["at"]] = part["v"]
        m = m.reshape(d + 1, d + 1)
        result[bool(v), int(c)] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return result


VALIDATION = 0.2
VALIDATION_ROWS = 20_000
SHRINKAGE = [(a, b) for a in (0.02, 0.1, 0.3, 0.6, 1.0) for b in (0.001, 0.01, 0.05)]


class Gaussian:
    """A class density by its mean and the inverse of the Cholesky factor."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray):
        factor = np.linalg.cholesky(cov)
        self.mean = mean
        self.whiten = np.linalg.solve(factor, np.eye(len(cov)))
        self.logdet = 2 * float(np.log(np.diag(factor)).sum())

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return -0.5 * ((z * z).sum(axis=1) + self.logdet)


class Model:
    def __init__(self, classes: tuple[Gaussian, Gaussian] | None, scale: tuple[np.ndarray, np.ndarray] | None,
                 slope: float, offset: float):
        self.classes, self.scale, self.slope, self.offset = classes, scale, slope, offset

    def margin(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.zeros(len(x))
        x = (x - self.scale[0]) / self.scale[1]
        return self.classes[1].log_density(x) - self.classes[0].log_density(x)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -40, 40)))


def _log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))


def _slope_and_offset(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin (Newton, damped)."""
    spread = max(float(np.std(margin)), 1e-9)
    m = np.clip(margin / spread, -8, 8)
    design = np.stack([m, np.ones_like(m)], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((design * w[:, None]).T @ design + 1e-3 * np.eye(2),
                               design.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-6) / spread), float(beta[1])


def _validation_sample(rows: DataFrame, n_val: float) -> DataFrame:
    """At most about ``VALIDATION_ROWS`` of the ``n_val`` rows kept aside: ``u``
    keeps all copies of a text on one side, ``s`` takes each row by itself."""
    share = min(1.0, VALIDATION_ROWS / n_val)
    kept = rows.filter(F.col("u") < VALIDATION)
    if "s" not in rows.columns:
        return kept.filter(F.col("u") < VALIDATION * share)
    return kept.filter(F.col("s") < share)


def fit(rows: DataFrame) -> Model:
    """A model from rows (label, u, x) and, for the sample, ``s``. The moments come from all rows; the
    shrinkage, slope and offset from at most about ``VALIDATION_ROWS`` rows of
    the fifth that ``u`` keeps for it."""
    moments = _moments(rows)
    count = {c: sum(moments.get((v, c), (0,))[0] for v in (False, True)) for c in (0, 1)}
    if min(count.values()) == 0:
        odds = 40.0 if count[1] else -40.0 if count[0] else 0.0
        return Model(None, None, 0.0, odds)
    usable = all((False, c) in moments for c in (0, 1)) and any((True, c) in moments for c in (0, 1))

    def totals(with_validation: bool):
        out = []
        for c in (0, 1):
            parts = [moments[v, c] for v in ((False, True) if with_validation else (False,)) if (v, c) in moments]
            out.append([sum(p[k] for p in parts) for k in range(3)])
        return out

    def model(sums, a: float, b: float, slope: float = 1.0, offset: float = 0.0) -> Model:
        n = sums[0][0] + sums[1][0]
        mean = (sums[0][1] + sums[1][1]) / n
        var = np.diag(sums[0][2] + sums[1][2]) / n - mean ** 2
        sd = np.sqrt(np.maximum(var, 1e-8))
        covs, means = [], []
        for k, s, ss in sums:
            mu = s / k
            covs.append((ss / k - np.outer(mu, mu)) / np.outer(sd, sd))
            means.append((mu - mean) / sd)
        pooled = (sums[0][0] * covs[0] + sums[1][0] * covs[1]) / n
        eye = np.eye(len(sd))
        made = []
        for mu, cov in zip(means, covs):
            shrunk = (1 - a) * cov + a * pooled
            shrunk = (1 - b) * shrunk + b * max(np.trace(shrunk) / len(sd), 1e-3) * eye
            made.append(Gaussian(mu, (shrunk + shrunk.T) / 2 + 1e-9 * eye))
        return Model((made[0], made[1]), (mean, sd), slope, offset)

    if not usable:
        return model(totals(True), 0.3, 0.05, 1.0, float(np.log(count[1] / count[0])))
    n_val = sum(moments[True, c][0] for c in (0, 1) if (True, c) in moments)
    kept = _validation_sample(rows, n_val).select("label", "x").toArrow()
    x, y = _matrix(kept.column("x")), kept.column("label").to_numpy()
    if not len(y):
        return model(totals(True), 0.3, 0.05, 1.0, float(np.log(count[1] / count[0])))
    best = None
    for a, b in SHRINKAGE:
        m = model(totals(False), a, b)
        margin = m.margin(x)
        slope, offset = _slope_and_offset(margin, y)
        loss = _log_loss(1 / (1 + np.exp(-np.clip(slope * margin + offset, -40, 40))), y)
        if best is None or loss < best[0]:
            best = (loss, a, b, slope, offset)
    return model(totals(True), *best[1:])


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of rows (doc_id, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @in_task("quality")
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = m.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(predict, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = materialise(features(docs), "quality-features")
    marked = (labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
              .select("doc_id", F.col("quality").cast("int").alias("label")))
    model = fit(rows.filter(~held_out(F.col("doc_id"))).join(marked, "doc_id").select("label", "u", "s", "x"))
    return score(rows, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
