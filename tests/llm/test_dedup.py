"""Exact and near de-duplication against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from conftest import SF001
from pyspark.sql import functions as F
from tools.compare import TABLES, digest
from vigil.llm import near_dedup
from vigil.llm.catalog import QUERIES, SQL
from vigil.llm.components import components
from vigil.llm.exact_dedup import drop_exact, exact_groups
from vigil.llm.near_dedup import BINS, Words, drop_near, near_groups, shingles, sketch

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, rows)[0] == digest(rel.columns, rel.fetchall())[0]


EXACT = [(5, "a b"), (3, "a \n\t b"), (9, "a  b"), (7, None), (2, ""), (4, "A b"), (None, "a b"), (3, "a \n\t b"),
         (11, "a b"), (12, "x" * 5000 + "1"), (13, "x" * 5000 + "2"), (14, "x" * 5000 + "1")]


def test_exact_groups(spark):
    rows = exact_groups(spark.createDataFrame([(*r, "z") for r in EXACT], DOCS + ", kept string")).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in EXACT]
    expect = []
    for (i, _), t in zip(EXACT, norm):
        ids = [j for (j, _), u in zip(EXACT, norm) if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        expect.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[4])
    assert sorted(map(tuple, rows), key=key) == sorted(expect, key=key)


def test_drop_exact_keeps_one_row_of_each_text(spark):
    docs = spark.createDataFrame([(*r, k % 2) for k, r in enumerate(EXACT)], DOCS + ", __sha int")
    out = drop_exact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([
        (3, "a \n\t b"), (2, ""), (4, "A b"), (11, "a b"), (12, "x" * 5000 + "1"), (13, "x" * 5000 + "2")])
    assert drop_exact(docs.limit(0)).count() == 0


def brute(rows, n):
    """Components of documents by full pairwise Jaccard."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k:k + min(n, len(w))]) for k in range(len(w) - min(n, len(w)) + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows)}


def corpus(seed=5):
    """Groups of copies around the threshold, one of them a third of all rows,
    plus short texts, unrelated texts and texts sharing a passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = []
    for size in (120, 8, 8, 5, 3, 2, 2):
        base = [word() for _ in range(rnd.choice((30, 80, 200)))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 12))):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(40))
    texts += [" ".join(word() for _ in range(rnd.randrange(20, 60))) + " " + passage for _ in range(40)]
    texts += ["", None, " \t", "one", "One", "one two", "one  two", "one two three", "a b c d e", "a b c d e f"]
    texts += texts[:20]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n", [2, 5])
def test_near_groups_against_brute_force(spark, n):
    rows = corpus()
    got = near_groups(spark.createDataFrame(rows, DOCS).repartition(5), n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def template(size, seed=11):
    """Texts that share six words in ten: unlinked members of large buckets, but for
    a few near copies of each tenth text."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    shared, texts = [word() for _ in range(60)], []
    for k in range(size):
        own = [word() for _ in range(40)]
        texts.append(shared + own)
        if k % 10 == 0:
            own = list(own)
            own[k % 40] = word()
            texts.append(shared + own)
    rnd.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_blocks_of_unlinked_members_against_brute_force(spark, monkeypatch):
    rows = template(400)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    expect = brute(rows, 2)
    assert 300 < len({low for _, low in expect.values()}) < len(rows)
    # Few rows in a block, then more than one portion of heads in each block.
    for name, value in (("BLOCK", 16), ("REST", 32), ("MOST_HEADS", 64), ("MOST_REST", 128)):
        monkeypatch.setattr(near_dedup, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(docs, 2).collect()}
    assert got == expect


def test_rows_of_a_large_bucket_grow_with_its_members(spark):
    """Copies of a member that blocks get, from a table of one bucket alone."""
    for n in (5_000, 40_000):
        named = spark.range(n).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("rep"),
                                      F.col("id").alias("label"), F.lit(0).alias("band"))
        rows = near_dedup.bucket_blocks(named)
        assert rows.count() <= 2 * near_dedup.PARTS * n
        most = rows.groupBy("block").agg(F.sum(1 - F.col("role")).alias("heads")).agg(F.max("heads")).first()[0]
        assert most < near_dedup.PORTIONS * near_dedup.BLOCK


def test_drop_near_keeps_one_of_each_group_and_all_columns(spark):
    rows = corpus(6)
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], DOCS + ", fp int")
    out = drop_near(docs, 2)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, (_, low) in brute(rows, 2).items() if i == low}
    assert drop_near(docs.limit(0), 2).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text + " x"), (None, "alone here")], DOCS)
    rows = near_groups(docs, 2).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == sorted([
        ("None", "4", False), ("4", "4", True), ("4", "4", True), ("9", "4", False), ("None", "None", True)])


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        agree = []
        for size in (40, 400, 4000):
            for _ in range(6):
                pool = rnd.integers(0, 2**63, size=2 * size, dtype=np.uint64)
                both = int(round(share * size))
                only = (size - both) // 2
                a, b = pool[:both + only], np.concatenate([pool[:both], pool[both + only:both + 2 * only]])
                rows = sketch([np.unique(a), np.unique(b)])
                agree.append(((rows[0] == rows[1]).mean(), both / (both + 2 * only)))
        error = np.array([x - y for x, y in agree])
        assert abs(error.mean()) < 0.02 and np.abs(error).max() < 5 * (0.25 / BINS) ** 0.5


def test_shingle_rules():
    w = Words()
    assert len(shingles(None, 2, w)) == len(shingles(" \x0b\x0c", 2, w)) == 0
    assert (shingles("A\tb", 2, w) == shingles(" a \n B ", 2, w)).all()
    assert len(shingles("a b", 2, w)) == 1 and len(shingles("É é", 1, w)) == 2
    assert len(shingles("x x x x", 2, w)) == 1


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    chain = list(range(100, 160))
    rnd.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(500, k) for k in range(501, 900)] + [(7, 8), (8, 7), (9, 9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expect = dict.fromkeys(chain, 100) | dict.fromkeys(range(500, 900), 500) | {7: 7, 8: 7, 9: 9}
    assert got == expect
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
