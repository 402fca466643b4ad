"""Hard-negative mining by coordinate pruning in length buckets (operator 13).

Vectors become integers (floor of a multiple of each component) and a row's score
is its inner product with the anchor. An anchor's positives are the best rows of
its label; for each positive the best rows of other labels are wanted whose score
lies within a band given by the positive's score.

Rows of one label and one length bucket (lengths a factor of :data:`STEP` apart)
are dealt to lists of about :data:`LIST_ROWS` rows by a hash. A list holds the
directions of its rows sorted along every coordinate. To find the rows that
score at least ``t`` with an anchor, ``t`` over the anchor's length and the list's
largest length is the least cosine; along each of the anchor's :data:`FOCUS`
largest coordinates it leaves one range of feasible values. Rows within all
ranges are candidates, and only these are scored, exactly. A list is skipped
whole where the lengths alone rule it out.

The threshold comes from the data: a first pass over one long list gives each
anchor a score that enough rows reach, and the second pass looks in all other
lists for better ones only. Nothing that could be among the best is ever left
out, so results are exact.

Equal vectors of a label are one row with their smallest ids, and equal anchors
are searched once. Anchors are taken in blocks of about :data:`ANCHOR_BLOCK`; a
task holds one list and one block, and sends on the best few rows per anchor.

Defined results: rows with a null id or label and vectors that are null, empty or
hold null or non-finite components take no part; vectors of different lengths
never meet. Components are held to 2**26 either way, so that scores fit a long.
Rows are told apart by id, label and vector: wholly repeated rows count once.
Anchors without positives, and positives without negatives, give no row. Empty
tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import in_task, materialise
from vigil.llm.vectors import matrix, smallest_ids, usable

STEP = 1.1
LIST_ROWS = 8192
ANCHOR_BLOCK = 2048
FOCUS = 3
LARGEST = 2 ** 26
SLACK = 1e-9           # of a cosine: what rounding may take away

NOTHING = -(2 ** 62)   # below every score


# --- one list ------------------------------------------------------------------

class CoordinateList:
    """Rows with their directions sorted along every coordinate."""

    def __init__(self, rows: np.ndarray, ids: list):
        self.rows, self.ids = rows, ids
        self.first = np.array([i[0] for i in ids], np.int64)
        self.length = np.sqrt(np.einsum("ij,ij->i", rows.astype(np.float64), rows.astype(np.float64)))
        self.longest, self.shortest = float(self.length.max()), float(self.length.min())
        self.real = rows.astype(np.float64)
        direction = self.real / np.where(self.length > 0, self.length, 1.0)[:, None]
        self.order = np.argsort(direction, axis=0, kind="stable")
        self.sorted = np.take_along_axis(direction, self.order, axis=0)
        self.widest = float(np.abs(self.real).max())

    def least_cosine(self, length: float, threshold: float) -> float:
        """What the cosine of a row with at least this score is never below."""
        reach = length * (self.longest if threshold > 0 else self.shortest)
        if reach == 0:
            return 2.0 if threshold > 0 else -1.0
        return threshold / reach

    def candidates(self, anchor: np.ndarray, threshold: float) -> np.ndarray:
        """Rows that may score at least ``threshold`` with the anchor."""
        length = math.sqrt(float(anchor @ anchor))
        cosine = self.least_cosine(length, threshold) - SLACK
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return np.arange(len(self.rows))
        unit, angle = anchor / length, math.acos(cosine)
        count, used = np.zeros(len(self.rows), np.int8), 0
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            to_axis = math.acos(min(1.0, max(-1.0, unit[f])))
            low = math.cos(min(math.pi, to_axis + angle)) - SLACK
            high = math.cos(max(0.0, to_axis - angle)) + SLACK
            a = int(np.searchsorted(self.sorted[:, f], low, "left"))
            b = int(np.searchsorted(self.sorted[:, f], high, "right"))
            if b - a == len(self.rows):
                continue  # the range leaves nothing out
            count[self.order[a:b, f]] += 1
            used += 1
        return np.flatnonzero(count == used) if used else np.arange(len(self.rows))

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where these hold every sum."""
        if self.widest * float(np.abs(anchor).max()) * len(anchor) < 2 ** 52:
            return (self.real[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ anchor.astype(np.int64)

    def best(self, at: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """Which of the scored rows hold the n best ids: ties to the smaller."""
        if len(at) > 4 * n:  # what is below the n-th score cannot be among them
            keep = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
        else:
            keep = np.arange(len(at))
        return keep[np.lexsort((self.first[at[keep]], -score[keep]))][:n]


def _kth(score: np.ndarray, ids: list[list[int]], n: int) -> int:
    """The score of the n-th id of rows in descending order, or NOTHING."""
    seen = 0
    for s, i in zip(score, ids):
        seen += len(i)
        if seen >= n:
            return int(s)
    return NOTHING


# --- rows, lists, blocks ---------------------------------------------------------

def _clean(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: float) -> DataFrame:
    """Distinct (id, label, vec, dim) of the rows that take part."""
    whole = F.transform(F.col(vec_col), lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(
        F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x.cast("double") * scale)))))
        .cast("bigint"))
    return (rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vec_col)))
            .select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole.alias("vec"))
            .distinct().withColumn("dim", F.size("vec")))


def _length(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def lists_of(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(rows by list, lists): distinct vectors of a label with their ``keep`` smallest
    ids, dealt to lists (dim, label, step, part)."""
    own = materialise(smallest_ids(rows, ["dim", "label", "vec"], "id", keep).withColumn("length", _length("vec"))
                      .withColumn("step", F.when(F.col("length") > 0, F.floor(F.log("length") / math.log(STEP)))
                                  .otherwise(-1).cast("bigint")), "hard-rows")
    groups = ["dim", "label", "step"]
    lists = materialise(own.groupBy(*groups).agg(F.count("*").alias("n"), F.max("length").alias("longest"))
                        .withColumn("parts", F.ceil(F.col("n") / LIST_ROWS).cast("bigint")), "hard-lists")
    dealt = own.join(lists.select(*groups, "parts"), groups).withColumn("part", F.pmod(F.xxhash64("vec"), "parts"))
    return materialise(dealt.drop("parts", "length"), "hard-dealt"), lists


_KEYS = ["block", "dim", "label", "step", "part"]


def _look(rows: DataFrame, anchors: DataFrame, pairs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on each pair of a list and a block of anchors."""
    left = rows.join(pairs, ["dim", "label", "step", "part"]).select(*_KEYS, "vec", "ids")
    right = anchors.withColumnRenamed("label", "own").join(pairs, ["block", "dim"]).select(
        *_KEYS, *[c for c in anchors.columns if c not in ("block", "dim", "label")], "own")

    @in_task("hard")
    def run(tables):
        left, right = tables
        if left.num_rows and right.num_rows:
            yield fn(CoordinateList(matrix(left.column("vec"), np.int64), left.column("ids").to_pylist()), left, right)

    kinds = {"bigint": pa.int64(), "boolean": pa.bool_()}
    target = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([row for found in run((left, right)) for row in found], target)

    return left.groupBy(*_KEYS).cogroup(right.groupBy(*_KEYS)).applyInArrow(one, schema)


# --- positives ---------------------------------------------------------------------

def _positives_in(n: int):
    def find(lists: CoordinateList, left: pa.Table, right: pa.Table) -> list[dict]:
        out = []
        for key, vec, floor in zip(right.column("akey").to_pylist(), matrix(right.column("vec"), np.int64),
                                   right.column("floor").to_pylist()):
            at = lists.candidates(vec.astype(np.float64), float(floor))
            score = lists.scores(at, vec)
            fit = score >= floor
            at, score = at[fit], score[fit]
            for k in lists.best(at, score, n):
                own = bool((lists.rows[at[k]] == vec).all())
                out += [{"akey": key, "score": int(score[k]), "id": i, "own": own} for i in lists.ids[at[k]]]
        return out
    return find


def _every(lists: DataFrame) -> DataFrame:
    """(dim, label, step, longest, part) of every list."""
    return lists.select("dim", "label", "step", "longest", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))


def _top(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "id", *(["own"] if "own" in found.columns else []))
    return found.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def _first_pass(pairs: DataFrame, over: list[str]) -> DataFrame:
    """One pair per block: the list of the longest rows."""
    w = W.partitionBy(*over).orderBy(F.desc("longest"), "label", "step", "part")
    return pairs.withColumn("first", F.row_number().over(w) == 1)


def positives(rows: DataFrame, lists: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """(akey, score, id, own): the n best rows of each anchor's label; ``own`` if the
    row has the anchor's vector. ``anchors``: akey, dim, label, vec, length."""
    sizes = anchors.groupBy("dim", "label").agg(F.ceil(F.count("*") / ANCHOR_BLOCK).cast("bigint").alias("blocks"))
    blocked = materialise(anchors.join(sizes, ["dim", "label"]).withColumn(
        "block", F.xxhash64("label", F.pmod("akey", "blocks"))).drop("blocks"), "hard-anchors")
    pairs = blocked.select("block", "dim", "label").distinct().join(_every(lists), ["dim", "label"])
    pairs = materialise(_first_pass(pairs, ["block", "dim", "label"]), "hard-pairs")
    schema = "akey bigint, score bigint, id bigint, own boolean"
    start = blocked.select("block", "dim", "label", "akey", "vec", F.lit(NOTHING).alias("floor"))
    found = materialise(_top(_look(rows, start, pairs.filter("first").drop("first", "longest"), _positives_in(n), schema),
                             ["akey"], n), "hard-first")
    floor = found.filter(F.col("nth") == n).select("akey", F.col("score").alias("floor"))
    rest = blocked.join(floor, "akey", "left").select(
        "block", "dim", "label", "akey", "vec", "length", F.coalesce("floor", F.lit(NOTHING)).alias("floor"))
    again = _reaching(rest, pairs.filter(~F.col("first")), _positives_in(n), schema, rows)
    return materialise(_top(found.drop("nth").unionByName(again), ["akey"], n), "hard-positives")


def _reaching(anchors: DataFrame, pairs: DataFrame, fn, schema: str, rows: DataFrame) -> DataFrame:
    """The pass over the pairs that the lengths do not rule out: some anchor of the
    block, at its own length, could reach its floor with the list's longest row."""
    anchors = materialise(anchors, "hard-floors")
    need = anchors.groupBy("block").agg(F.min(F.when(F.col("floor") <= 0, 0.0).otherwise(
        F.col("floor") / F.greatest("length", F.lit(1e-300)))).alias("need"))
    pairs = materialise(pairs.join(need, "block").filter(F.col("longest") * (1 + SLACK) >= F.col("need"))
                        .drop("need", "first", "longest"), "hard-pairs")
    return _look(rows, anchors.drop("length"), pairs, fn, schema)


# --- negatives ---------------------------------------------------------------------

def _negatives_in(n: int):
    def find(lists: CoordinateList, left: pa.Table, right: pa.Table) -> list[dict]:
        label, out = left.column("label")[0].as_py(), []
        for key, vec, own, bands in zip(right.column("akey").to_pylist(), matrix(right.column("vec"), np.int64),
                                        right.column("own").to_pylist(), right.column("bands").to_pylist()):
            if own == label:
                continue
            low = min(max(b["low"], b["floor"]) for b in bands)
            at = lists.candidates(vec.astype(np.float64), float(low))
            score = lists.scores(at, vec)
            fit = score >= low
            at, score = at[fit], score[fit]
            for b in bands:
                inside = np.flatnonzero((score >= max(b["low"], b["floor"])) & (score <= b["high"]))
                for k in inside[lists.best(at[inside], score[inside], n)]:
                    out += [{"akey": key, "positive": b["positive"], "score": int(score[k]), "id": i}
                            for i in lists.ids[at[k]]]
        return out
    return find


def negatives(rows: DataFrame, lists: DataFrame, anchors: DataFrame, bands: DataFrame, n: int) -> DataFrame:
    """(akey, positive, score, id, nth): for each band (akey, positive, low, high) the n
    best rows of other labels whose score lies in it."""
    bands = materialise(bands.filter(F.col("low") <= F.col("high")), "hard-bands")
    schema = "akey bigint, positive bigint, score bigint, id bigint"

    def with_bands(floors: DataFrame) -> DataFrame:
        # A handful per anchor: one for each distinct score of a positive.
        packed = floors.groupBy("akey").agg(F.collect_list(F.struct("positive", "low", "high", "floor")).alias("bands"))
        return anchors.join(packed, "akey").withColumn("floor", F.array_min(F.transform(
            "bands", lambda b: F.greatest(b["low"], b["floor"]))))

    own = with_bands(bands.withColumn("floor", F.lit(NOTHING)))
    sizes = own.groupBy("dim").agg(F.ceil(F.count("*") / ANCHOR_BLOCK).cast("bigint").alias("blocks"))
    placed = materialise(own.join(sizes, "dim").select("akey", F.xxhash64("dim", F.pmod("akey", "blocks")).alias("block")),
                         "hard-blocks")
    blocked = own.join(placed, "akey")
    pairs = blocked.select("block", "dim").distinct().join(_every(lists), "dim")
    pairs = materialise(_first_pass(pairs, ["block", "dim"]), "hard-pairs")
    columns = ["block", "dim", "label", "akey", "vec", "bands"]
    found = materialise(_top(_look(rows, blocked.select(*columns), pairs.filter("first").drop("first", "longest"),
                                   _negatives_in(n), schema), ["akey", "positive"], n), "hard-negatives-first")
    floor = found.filter(F.col("nth") == n).select("akey", "positive", F.col("score").alias("floor"))
    raised = bands.join(floor, ["akey", "positive"], "left").withColumn("floor", F.coalesce("floor", F.lit(NOTHING)))
    rest = with_bands(raised).join(placed, "akey").select(*columns, "length", "floor")
    again = _reaching(rest, pairs.filter(~F.col("first")), _negatives_in(n), schema, rows)
    return materialise(_top(found.drop("nth").unionByName(again), ["akey", "positive"], n), "hard-negatives")


# --- the operator --------------------------------------------------------------------

def mine(vectors: DataFrame, anchors: Column, id_col: str, vec_col: str, label: Column, scale: float = 256.0,
         n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``:
    for each row that ``anchors`` marks and each of its ``n_positives`` best rows of
    the same label, the ``n_negatives`` best rows of other labels that score
    between ``low`` and ``high`` percent of the positive's score."""
    rows = materialise(_clean(vectors, id_col, vec_col, label, scale), "hard-clean")
    # One more positive than asked for: the anchor itself is among them.
    by_list, lists = lists_of(rows, max(n_positives + 1, n_negatives))
    marked = _clean(vectors.filter(F.coalesce(anchors, F.lit(False))), id_col, vec_col, label, scale)
    asked = materialise(marked, "hard-asked")
    own = materialise(asked.select("dim", "label", "vec").distinct()
                      .withColumn("akey", F.monotonically_increasing_id())
                      .withColumn("length", _length("vec")), "hard-own")
    best = positives(by_list, lists, own, n_positives + 1)
    # Whole numbers throughout; a negative score has an empty band.
    bands = best.filter(F.col("score") >= 0).select(
        "akey", F.col("score").alias("positive"), F.expr(f"(score * {low} + 99) div 100").alias("low"),
        F.expr(f"score * {high} div 100").alias("high")).distinct()
    against = negatives(by_list, lists, own, bands, n_negatives)
    back = asked.join(own.drop("length"), ["dim", "label", "vec"]).select(F.col("id").alias("anchor_id"), "akey")
    order = W.partitionBy("anchor_id", "akey").orderBy("nth")
    mine_ = (back.join(best, "akey").filter(~(F.col("own") & (F.col("id") == F.col("anchor_id"))))
             .withColumn("at", F.row_number().over(order)).filter(F.col("at") <= n_positives)
             .select("anchor_id", "akey", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    return (mine_.join(against.select("akey", F.col("positive").alias("positive_score"), F.col("nth").alias("rank"),
                                      F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
                       ["akey", "positive_score"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


ANCHORS_EVERY = 50


def noisy_label(vec_id: Column, label: Column) -> Column:
    """The label to learn from: that of every seventh id is the next one."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vec_id = F.col("vec_id")
    return mine(vectors, vec_id % ANCHORS_EVERY == 0, "vec_id", "embedding", noisy_label(vec_id, F.col("label")))
