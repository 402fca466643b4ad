"""Nearest neighbours with vantage-point trees per shard (operator 12).

Equal vectors become one row with their smallest ids. A small top tree, fitted
on a bounded sample, cuts the space into regions; a region's rows are dealt to
shards of about :data:`SHARD_ROWS` rows by a hash, and each shard gets a
vantage-point tree of its own: a node is a vantage point, the half of the rows
nearer to it and the half farther away, with the largest and the smallest of
their distances. The index is a table whose rows stand in tree order.

A query is searched in its own region first; the k-th distance found there is
its radius. It then visits the other regions, and within a shard the nodes, that
the triangle inequality cannot rule out: with ``d`` the distance to a vantage
point, the near half is left out if ``d - factor * radius`` lies beyond it, the
far half if ``d + factor * radius`` lies short of it. With ``factor`` 1 nothing
nearer is ever left out: the search is exact. Smaller factors visit less and may
miss neighbours.

Distances are Euclidean, of the original vectors, added up component by
component in double precision. A matrix product with a margin for rounding only
picks the rows for which that is done.

Bounds: the top tree is fitted on about :data:`SAMPLE` distinct vectors, which is
all that the driver sees besides a count per region; a task holds one shard and
at most about :data:`QUERY_BLOCK` queries.

Defined results: rows with a null id, and vectors that are null, empty, zero or
hold null or non-finite components take no part. Vectors of different lengths
never meet: the top tree covers the most frequent length, and each other length
is a region of its own. Rows are told apart by id and vector: wholly repeated
rows count once, and rows that share an id but not the vector are candidates of
each other. A query is never its own neighbour. Fewer candidates than k give
fewer rows; empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import in_task, materialise, unit_hash
from vigil.llm.vectors import arrays, matrix, smallest_ids, usable

SAMPLE = 8192
REGION_ROWS = 16_384
REGION_SAMPLE = 32      # sampled rows that a region of the top tree has at least
SHARD_ROWS = 8192
QUERY_BLOCK = 2048
LEAF = 128
TRIALS = 8              # vantage points tried for a node
EPS = 1e-9              # of lengths: what rounding may add to a distance


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows to rows, added up in the order of the components."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for k in range(a.shape[1]):
            d = a[:, k] - b[:, k]
            out += d * d
    return np.sqrt(out)


def _to(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return distances(rows, np.broadcast_to(point, rows.shape))


def _vantage(rows: np.ndarray) -> int:
    """Of a few evenly spaced rows the one whose distances spread most."""
    tried = np.unique(np.linspace(0, len(rows) - 1, TRIALS).astype(int))
    some = rows[:: max(1, len(rows) // 256)]
    with np.errstate(over="ignore", invalid="ignore"):
        spread = [np.nan_to_num(np.std(_to(some, rows[k])), nan=0.0, posinf=0.0) for k in tried]
    return int(tried[int(np.argmax(spread))])


# --- top tree -----------------------------------------------------------------

@dataclass
class Top:
    """Vantage points and radii of a complete binary tree; region r is the leaf
    whose path from the root are the bits of r."""
    dim: int
    depth: int
    points: np.ndarray    # node 1 is the root, 2n and 2n + 1 the halves of n
    radii: np.ndarray

    def region(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            far = distances(rows, self.points[node]) > self.radii[node]
            node = 2 * node + far
        return node - (1 << self.depth)

    def visited(self, rows: np.ndarray, radius: np.ndarray, factor: float) -> list[np.ndarray]:
        """The regions that may hold rows within the radius of each query."""
        which, node = np.arange(len(rows)), np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            d = distances(rows[which], self.points[node])
            reach = factor * radius[which] + EPS * (1 + d)
            near, far = ~(d - reach > self.radii[node]), ~(d + reach < self.radii[node])
            which = np.concatenate([which[near], which[far]])
            node = np.concatenate([2 * node[near], 2 * node[far] + 1])
        order = np.lexsort((node, which))
        cut = np.searchsorted(which[order], np.arange(1, len(rows)))
        return np.split(node[order] - (1 << self.depth), cut)


def fit_top(sample: np.ndarray, dim: int, regions: int) -> Top:
    depth = max(0, min(math.ceil(math.log2(max(regions, 1))), int(math.log2(max(1, len(sample) // REGION_SAMPLE)))))
    points, radii = np.zeros((1 << depth, dim)), np.zeros(1 << depth)

    def split(node: int, rows: np.ndarray) -> None:
        if node >= 1 << depth:
            return
        if len(rows):
            points[node] = rows[_vantage(rows)]
            d = _to(rows, points[node])
            radii[node] = np.median(d)
            split(2 * node, rows[d <= radii[node]])
            split(2 * node + 1, rows[d > radii[node]])

    split(1, sample)
    return Top(dim, depth, points, radii)


# --- a shard's tree ------------------------------------------------------------

def tree_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, inner, outer) of a tree over the rows. The node over places lo to hi
    has its vantage point at lo, the nearer half after it up to the middle and the
    farther half behind; ``inner`` is the largest distance of the one and
    ``outer`` the smallest of the other. Places in leaves hold zeros."""
    order, n = np.arange(len(rows)), len(rows)
    inner, outer = np.zeros(n), np.zeros(n)
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            continue
        own = order[lo:hi]
        k = _vantage(rows[own])
        own[[0, k]] = own[[k, 0]]
        d = _to(rows[own[1:]], rows[own[0]])
        by = np.argsort(d, kind="stable")
        own[1:] = own[1:][by]
        mid = _middle(lo, hi)
        inner[lo], outer[lo] = d[by[mid - lo - 2]], d[by[mid - lo - 1]]
        todo += [(lo + 1, mid), (mid, hi)]
    return order, inner, outer


def _middle(lo: int, hi: int) -> int:
    return lo + 1 + (hi - lo) // 2


class Shard:
    """A shard's rows in tree order, searched for many queries at once."""

    def __init__(self, rows: np.ndarray, ids: list, inner: np.ndarray, outer: np.ndarray):
        self.rows, self.ids, self.inner, self.outer = rows, ids, inner, outer
        self.first = np.array([i[0] for i in ids], np.int64)
        with np.errstate(over="ignore"):
            self.norms = np.einsum("ij,ij->i", rows, rows)

    def search(self, queries: np.ndarray, radius: np.ndarray, k: int, factor: float):
        """(query, row, distance) of the k nearest rows of each query, as far as
        they are within its radius; ties to the smaller first id."""
        self.queries, self.k, self.factor = queries, k, factor
        with np.errstate(over="ignore"):
            self.q_norms = np.einsum("ij,ij->i", queries, queries)
        self.dist = np.full((len(queries), k), np.inf)
        self.at = np.full((len(queries), k), -1, np.int64)
        self.radius = radius.astype(np.float64).copy()
        self._node(0, len(self.rows), np.arange(len(queries)))
        q, c = np.nonzero(self.at >= 0)
        return q, self.at[q, c], self.dist[q, c]

    def _node(self, lo: int, hi: int, active: np.ndarray) -> None:
        if not len(active) or lo >= hi:
            return
        if hi - lo <= LEAF:
            self._scan(lo, hi, active)
            return
        d = _to(self.queries[active], self.rows[lo])
        self._merge(active, np.full(len(active), lo), d)
        mid = _middle(lo, hi)
        nearer = d <= (self.inner[lo] + self.outer[lo]) / 2
        # Queries inside take the near half first, the others the far half.
        for own in (nearer, ~nearer):
            halves = [(lo + 1, mid, True), (mid, hi, False)]
            for a, b, near in halves if own is nearer else halves[::-1]:
                q, x = active[own], d[own]
                reach = self.factor * self.radius[q] + EPS * (1 + x)
                keep = ~(x - reach > self.inner[lo]) if near else ~(x + reach < self.outer[lo])
                self._node(a, b, q[keep])

    def _scan(self, lo: int, hi: int, active: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            scale = self.q_norms[active][:, None] + self.norms[lo:hi][None, :]
            about = scale - 2 * (self.queries[active] @ self.rows[lo:hi].T)
            limit = self.radius[active] ** 2
            if hi - lo > self.k:  # the k-th of these rows is a bound too
                limit = np.minimum(limit, np.partition(np.nan_to_num(about, nan=np.inf), self.k - 1, axis=1)[:, self.k - 1]
                                   + 2 * EPS * scale.max(axis=1))
            q, c = np.nonzero(~(about > limit[:, None] + EPS * scale))
        if len(q):
            at = active[q]
            self._merge(at, lo + c, distances(self.queries[at], self.rows[lo + c]))

    def _merge(self, q: np.ndarray, row: np.ndarray, d: np.ndarray) -> None:
        """Takes (query, row, distance) into the queries' lists."""
        fit = d <= self.radius[q]
        q, row, d = q[fit], row[fit], d[fit]
        if not len(q):
            return
        own = np.unique(q)
        all_q = np.concatenate([np.repeat(own, self.k), q])
        all_row = np.concatenate([self.at[own].ravel(), row])
        all_d = np.concatenate([self.dist[own].ravel(), d])
        ids = np.where(all_row >= 0, self.first[all_row], np.iinfo(np.int64).max)
        order = np.lexsort((ids, all_row < 0, all_d, all_q))
        starts = np.searchsorted(all_q[order], own)
        best = order[starts[:, None] + np.arange(self.k)]  # each query has k entries at least
        self.at[own], self.dist[own] = all_row[best], all_d[best]
        self.radius[own] = np.minimum(self.radius[own], self.dist[own, -1])


# --- distributed steps -----------------------------------------------------------

def _clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, vec, dim) of the rows that take part."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))
    return (rows.filter(F.col("id").isNotNull() & usable(F.col("vec")))
            .filter(F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec")))


def _regions(top: Top):
    """Region of each vector: that of the top tree, or -length."""
    @F.pandas_udf("bigint")
    def region(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vecs in batches:
            size = np.array([len(v) for v in vecs])
            out = -size.astype(np.int64)
            own = size == top.dim
            if own.any():
                out[own] = top.region(np.stack(vecs[own].to_list()))
            yield pd.Series(out)
    return region


@dataclass
class Index:
    """``rows``: (region, part, pos, vec, ids, inner, outer), stored; ``shards``:
    (region, parts); ``keep``: ids held of each vector."""
    top: Top
    rows: DataFrame
    shards: DataFrame
    keep: int


def build_index(vectors: DataFrame, id_col: str, vec_col: str, keep: int) -> Index:
    """The index of the vectors; a search may ask for up to ``keep`` - 1 neighbours."""
    spark = vectors.sparkSession
    own = materialise(smallest_ids(_clean(vectors, id_col, vec_col), ["dim", "vec"], "id", keep), "vp-vectors")
    sizes = own.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["n"]) if sizes else (0, 0)
    sample = (own.filter((F.col("dim") == dim) & (unit_hash(F.col("vec")) < SAMPLE / max(n, 1)))
              .select("vec").orderBy(F.xxhash64("vec")).limit(2 * SAMPLE).toArrow())
    top = fit_top(matrix(sample.column("vec")), dim, math.ceil(n / REGION_ROWS))
    placed = materialise(own.withColumn("region", _regions(top)("vec")), "vp-placed")
    shards = materialise(placed.groupBy("region").agg(
        F.ceil(F.count("*") / SHARD_ROWS).cast("bigint").alias("parts")), "vp-shards")
    dealt = placed.join(shards, "region").withColumn("part", F.pmod(F.xxhash64("vec"), "parts"))

    def plant(table: pa.Table) -> pa.Table:
        order, inner, outer = tree_order(matrix(table.column("vec")))
        return table.take(pa.array(order)).append_column("pos", pa.array(np.arange(len(order)))).append_column(
            "inner", pa.array(inner)).append_column("outer", pa.array(outer)).select(
            ["region", "part", "pos", "vec", "ids", "inner", "outer"])

    rows = (dealt.select("region", "part", "vec", "ids").groupBy("region", "part").applyInArrow(
        plant, "region bigint, part bigint, pos bigint, vec array<double>, ids array<bigint>, inner double, outer double"))
    return Index(top, materialise(rows, "vp-index"), shards, keep)


def _search(index: Index, queries: DataFrame, k: int, factor: float) -> DataFrame:
    """(qkey, score, id): of each (qkey, vec, radius, region) the best ids of each
    shard of its region."""
    blocks = queries.groupBy("region").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("bigint").alias("blocks"))
    plan = materialise(index.shards.join(blocks, "region"), "vp-plan")  # one row per region
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    keys = ["region", "part", "block"]
    rows = index.rows.join(plan, "region").withColumn("block", block).select(
        *keys, "pos", "vec", "ids", "inner", "outer")
    asked = (queries.join(plan, "region").withColumn("block", F.pmod(F.xxhash64("qkey"), "blocks"))
             .withColumn("part", part).select(*keys, "qkey", "vec", "radius"))

    @in_task("vantage")
    def find(tables):
        left, right = tables
        if not left.num_rows or not right.num_rows:
            return
        left = left.sort_by("pos")
        ids = left.column("ids").to_pylist()
        shard = Shard(matrix(left.column("vec")), ids, left.column("inner").to_numpy(), left.column("outer").to_numpy())
        q, row, d = shard.search(matrix(right.column("vec")), right.column("radius").to_numpy(), k, factor)
        size = np.array([len(ids[r]) for r in row], np.int64)
        key = right.column("qkey").to_numpy()[q]
        yield pa.record_batch([pa.array(np.repeat(key, size)), pa.array(np.repeat(d, size)),
                               pa.array([i for r in row for i in ids[r]], pa.int64())], ["qkey", "score", "id"])

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(find((left, right)))
        return (pa.Table.from_batches(found) if found else
                pa.table({"qkey": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], pa.int64())}))

    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(one, "qkey bigint, score double, id bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("qkey").orderBy("score", "id")
    return found.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def nearest(index: Index, queries: DataFrame, id_col: str, vec_col: str, k: int, factor: float = 1.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of each row of
    ``queries``, itself left out."""
    if not 0 < factor <= 1:
        raise ValueError("factor must lie above 0 and not above 1")
    if k + 1 > index.keep:
        raise ValueError(f"this index holds {index.keep} ids a vector; {k} neighbours need {k + 1}")
    # Each distinct vector is searched once, for one row more: the query's own.
    asked = materialise(_clean(queries, id_col, vec_col).distinct(), "vp-asked")
    own = materialise(asked.select("vec", "dim").distinct().withColumn("qkey", F.monotonically_increasing_id())
                      .withColumn("home", _regions(index.top)("vec")), "vp-queries")
    at_home = own.select("qkey", "vec", F.lit(float("inf")).alias("radius"), F.col("home").alias("region"))
    first = materialise(_best(_search(index, at_home, k + 1, factor), k + 1), "vp-first")
    radius = first.filter(F.col("nth") == k + 1).select("qkey", F.col("score").alias("radius"))
    reach = own.filter(F.col("home") >= 0).join(radius, "qkey", "left").select(
        "qkey", "vec", "home", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
    top = index.top

    @F.pandas_udf("array<bigint>")
    def visits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vecs, r in batches:
            yield pd.Series(top.visited(np.stack(vecs.to_list()), r.to_numpy(), factor) if len(vecs) else [])

    away = materialise(reach.withColumn("region", F.explode(visits("vec", "radius")))
                       .filter(F.col("region") != F.col("home")).select("qkey", "vec", "radius", "region"), "vp-visits")
    found = first.drop("nth").unionByName(_search(index, away, k + 1, factor))
    best = materialise(_best(found, k + 1), "vp-best")
    # A query's own row is the one with its id at distance 0.
    back = asked.join(own, ["dim", "vec"]).select(F.col("id").alias("query_id"), "qkey")
    rows = back.join(best, "qkey").withColumn("own", (F.col("id") == F.col("query_id")) & (F.col("score") == 0))
    before = W.partitionBy("query_id", "qkey").orderBy("nth")
    return (rows.filter(~F.col("own")).withColumn("rank", F.row_number().over(before))
            .filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score"))


NEAREST = 10
FACTOR = 1.0


def is_query(id_col: Column, every: int) -> Column:
    return F.coalesce(id_col % every == 0, F.lit(False))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = build_index(vectors, "vec_id", "embedding", NEAREST + 1)
    return nearest(index, vectors.filter(is_query(F.col("vec_id"), 100)), "vec_id", "embedding", NEAREST, FACTOR)
