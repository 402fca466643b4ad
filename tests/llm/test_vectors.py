"""Nearest neighbours and hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from vigil.llm import hard_negatives as H
from vigil.llm import vantage as V

SCHEMA = "vec_id long, embedding array<double>, label int, dim string, score int"


def _finite(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def rows():
    """Random vectors of two lengths, a third of all rows one vector, repeated
    rows, ids with two vectors, and what takes no part."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(500):
        k = i % 6
        v = ((rng.normal(size=3) * rng.choice([.01, 1, 3])).round(2) if k < 3 else np.array([1., 2., 3.]) if k < 5
             else rng.normal(size=2).round(0))
        out.append((i, v.tolist(), int(rng.integers(0, 4)) if i % 11 else None))
    out += out[:40] + [(5, [9., 9., 9.], 1), (50, [9., 9., 8.], 1), (600, [-0.0, 2., 0.], 2), (601, [0.0, 2., -0.0], 2)]
    nan, inf = float("nan"), float("inf")
    out += [(None, [1., 2., 3.], 1), (1000, None, 1), (1050, [0., 0., 0.], 1), (1100, [1., None, 2.], 1),
            (1150, [nan, 1., 2.], 1), (1200, [], 1), (1250, [inf, 1., 1.], 1), (1300, [1e300, 0., -1e300], 2)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)


def _nearest(rows, every, k):
    good = sorted({(i, tuple(x + 0.0 for x in v)) for i, v, _ in rows if i is not None and _finite(v) and any(v)})
    out = []
    for i, v in good:
        if i % every:
            continue
        near = []
        for j, w in good:
            if len(w) == len(v) and (j, w) != (i, v):
                total = 0.0
                for x, y in zip(v, w):
                    total += (x - y) * (x - y)
                near.append((math.sqrt(total), j))
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.fixture()
def small(monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("REGION_ROWS", 90), ("QUERY_BLOCK", 7), ("LEAF", 8), ("REGION_SAMPLE", 8)):
        monkeypatch.setattr(V, name, value)
    for name, value in (("LIST_ROWS", 40), ("ANCHOR_BLOCK", 7)):
        monkeypatch.setattr(H, name, value)


def test_nearest_is_exact_at_factor_one(table, rows, small):
    index = V.build_index(table, "vec_id", "embedding", 6)
    assert index.top.depth >= 1
    queries = table.filter(V.is_query(F.col("vec_id"), 10))
    got = [tuple(r) for r in V.nearest(index, queries, "vec_id", "embedding", 5).collect()]
    assert sorted(got) == _nearest(rows, 10, 5)


def test_smaller_factors_miss_little(table, rows, small):
    index = V.build_index(table, "vec_id", "embedding", 6)
    queries = table.filter(V.is_query(F.col("vec_id"), 10))
    got = V.nearest(index, queries, "vec_id", "embedding", 5, 0.3).collect()
    want = {(a, c) for a, _, c, _ in _nearest(rows, 10, 5)}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    with pytest.raises(ValueError):
        V.nearest(index, queries, "vec_id", "embedding", 5, 1.5)
    with pytest.raises(ValueError):
        V.nearest(index, queries, "vec_id", "embedding", 6)


def test_a_tree_leaves_nodes_out():
    """On clustered rows most leaves are ruled out, without a loss."""
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(c * 100, 1, (200, 4)) for c in range(20)])
    order, inner, outer = V.tree_order(rows)
    scanned = []

    class Counted(V.Shard):
        def _scan(self, lo, hi, active):
            scanned.append(len(active) * (hi - lo))
            super()._scan(lo, hi, active)

    shard = Counted(rows[order], [[int(i)] for i in order], inner, outer)
    q, at, d = shard.search(rows[:50], np.full(50, np.inf), 5, 1.0)
    for k in range(50):
        want = np.lexsort((np.arange(len(rows)), V._to(rows, rows[k])))[:5]
        assert [int(order[i]) for i in at[q == k]] == want.tolist()
    assert sum(scanned) < 0.2 * 50 * len(rows)


def test_top_tree_visits_what_it_must():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(2000, 5))
    top = V.fit_top(rows[:500], 5, 8)
    region = top.region(rows)
    radius = np.array([np.sort(V._to(rows, r))[10] for r in rows[:40]])
    for r, seen, d in zip(rows[:40], top.visited(rows[:40], radius, 1.0), radius):
        assert set(region[V._to(rows, r) <= d]) <= set(seen.tolist())


def _mined(rows, every, n_pos=5, n_neg=3):
    good = set()
    for i, v, label in rows:
        if i is not None and label is not None and _finite(v):
            good.add((i, (label + 1) % 10 if i % 7 == 0 else label,
                      tuple(int(max(-2 ** 26, min(2 ** 26, math.floor(256 * x)))) for x in v)))
    good, out = sorted(good), []
    for a in good:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], g[2])), g[0], g[1] == a[1]) for g in good
                        if g != a and len(g[2]) == len(a[2]))
        for p, pid, _ in [s for s in scored if s[2]][:n_pos]:
            fit = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a[0], pid, r + 1, nid, -p, -s) for r, (s, nid, _) in enumerate(fit[:n_neg])]
    return sorted(out)


@pytest.mark.parametrize("every", [50, 7])
def test_hard_negatives(table, rows, small, every):
    v = F.col("vec_id")
    got = H.mine(table, v % every == 0, "vec_id", "embedding", H.noisy_label(v, F.col("label")))
    assert sorted(map(tuple, got.collect())) == _mined(rows, every)


def test_coordinate_ranges_leave_rows_out_but_no_result():
    rng = np.random.default_rng(7)
    rows = np.floor(rng.normal(size=(3000, 8)) * [900, 500, 200, 50, 50, 20, 9, 2]).astype(np.int64)
    lists = H.CoordinateList(rows, [[i] for i in range(len(rows))])
    looked = 0
    for anchor in rows[:60]:
        score = rows @ anchor
        for t in (int(np.sort(score)[-20]), 1, 0, -5, int(score.min())):
            at = lists.candidates(anchor.astype(float), t)
            assert set(np.flatnonzero(score >= t)) <= set(at.tolist())
            if t > 1:
                looked += len(at)
    assert looked < 0.7 * 60 * len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert V.nearest(V.build_index(none, "vec_id", "embedding", 6), none, "vec_id", "embedding", 5).collect() == []
    assert H.mine(none, F.col("vec_id") % 50 == 0, "vec_id", "embedding", F.col("label")).collect() == []


def test_nearest_on_the_given_vectors(spark):
    """Default sizes; recall against brute force is 1."""
    vectors = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    index = V.build_index(vectors, "vec_id", "embedding", 11)
    got = V.nearest(index, vectors.filter(V.is_query(F.col("vec_id"), 100)), "vec_id", "embedding", 10).collect()
    assert sorted(map(tuple, got)) == _nearest(rows, 100, 10)
