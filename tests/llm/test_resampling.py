"""Importance resampling against a plain version, and its parts against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vigil.llm.resampling import Dictionary, compose, feature_buckets, gains, noise, resample

WORDS = ["a", "b1", "é", "日本", "foo", "x" * 70, "zz\x85q", "Ünd", "ß", "İ"]


def _words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _features(text, n):
    w = _words(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def _texts(seed, count):
    rng = random.Random(seed)
    mark = [" ", ".", "\n", ", ", "-", "  ", "?!", "\x00", "\t"]
    return [None, "", " .", *("".join(rng.choice(mark) + rng.choice(WORDS) for _ in range(rng.randint(0, 40)))
                              + rng.choice(mark) for _ in range(count))]


def test_composed_crc_is_that_of_the_joined_bytes():
    rng = random.Random(4)
    parts = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 7, 300]))) for _ in range(200)]
    got = compose(np.array([zlib.crc32(a) for a, _ in parts], np.uint64), np.array([zlib.crc32(b) for _, b in parts], np.uint64),
                  np.array([len(b) for _, b in parts], np.int64))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("known", [[], ["a", "foo", "é", "日本"], WORDS])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_buckets_whatever_the_dictionary_holds(known, n):
    texts = _texts(n, 60)
    got = feature_buckets(texts, Dictionary(known), n, 997)
    assert [g.tolist() for g in got] == [[zlib.crc32(f.encode()) % 997 for f in _features(t, n)] for t in texts]


def _plain(docs, target, n, buckets, min_words, draw):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source = Counter(bucket(f) for _, t in docs for f in _features(t, n))
    goal = Counter(bucket(f) for t in target for f in _features(t, n))
    size, total = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log(float(goal[b] + 1) * float(size + buckets) / (float(source[b] + 1) * float(total + buckets))))
            for b in range(buckets)]
    rows = []
    for i, t in docs:
        f = _features(t, n)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [r for r, (_, t) in zip(rows, docs) if len(_words(t)) >= min_words]
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:draw(len(fit))]):
        r[4] = k + 1
    return rows


@pytest.mark.parametrize("n", [1, 2])
def test_resampling_equals_the_plain_version(spark, n):
    texts = _texts(8, 150)
    docs = list(enumerate(texts)) + [(7, texts[9])] * 20 + [(None, texts[20]), (None, None)]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, packed string, rank int")
    target = spark.createDataFrame([(t,) for t in _texts(9, 10)], "text string")
    draw = lambda k: k // 2
    got = resample(rows.repartition(5), target, n=n, buckets=50, min_words=8, draw=draw)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: [(x is None, x) for x in r]
    plain = _plain(docs, _texts(9, 10), n, 50, 8, draw)
    # Rows with one id and text are alike: only the ranks as a set are defined.
    assert sorted((list(r) for r in got.collect()), key=key) == sorted(plain, key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).collect() == []
    one = resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).first()
    assert (one.n_features, one.rank) == (2, None)


def test_gains_and_noise():
    assert gains(np.array([1, 0]), np.array([0, 0])).tolist() == [math.floor(1000 * math.log(3 / 4)), math.floor(1000 * math.log(3 / 2))]
    assert noise(0) < noise(2 ** 31) < noise(2 ** 32 - 1)


def test_very_long_text(spark):
    text = "Word 1, é! " * 200_000
    row = resample(spark.createDataFrame([(1, text), (2, "é")], "doc_id long, text string"),
                   spark.createDataFrame([("é",)], "text string"), draw=lambda k: k).orderBy("doc_id").collect()
    assert [(r.n_features, r.rank) for r in row] == [(600_000, 1), (1, None)]
