"""Target-distribution importance resampling with an Aho-Corasick dictionary
(operator 11).

Texts are lower-cased (A-Z only), every run of ASCII characters that are neither
letter nor digit becomes one blank, and what is between blanks is a word. A
feature is a run of 1 to ``n`` consecutive words joined by one blank; its bucket
is the unsigned crc32 of its UTF-8 bytes modulo ``buckets``.

A dictionary of words, each with blanks before and after it, is compiled into
an Aho-Corasick automaton. One scan of a text emits the payload of every word of
the dictionary: its CRC and its length in bytes. What lies between two matches
are words that the dictionary does not hold; they get the same payload from
their bytes, so the dictionary decides the speed and never a result. The CRC of
a longer run is composed from the payloads of its words, without its bytes
(:func:`compose`). A text's buckets are written once; counting and scoring read
these and not the texts.

The dictionary holds at most :data:`DICT_WORDS` words of at most
:data:`DICT_BYTES` bytes, the most frequent of a sample of about
:data:`DICT_TEXTS` texts. The counts and gains are ``buckets`` numbers, whatever
the input. Every count covers all texts.

The draw is a Gumbel-top-k: one score per document, and the highest scores of
those with ``min_words`` words. Ranks come from one range partitioning by score,
places within the sorted partitions and the partitions' sizes, so no task sees
more than its range.

Defined results: null and empty texts have no features, weight 0, and are scored
like others. A null ``doc_id`` is hashed as the empty string and comes last
among equal scores. Every row gives one result row; repeated rows score alike
and are ranked one after the other. Without documents the result is empty;
without target texts all T and t are 0. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import CACHES, CHUNK_BYTES, chunks, in_task, materialise, unit_hash

BUCKETS = 10_000
WORDS_IN_FEATURE = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024

DICT_WORDS = 50_000
DICT_BYTES = 64
DICT_TEXTS = 4_000

_ASCII = {c: (chr(c + 32) if 65 <= c <= 90 else chr(c) if 48 <= c <= 57 or 97 <= c <= 122 else " ")
          for c in range(128)}
_BLANKS = re.compile("  +")


def normalised(text: str | None) -> str:
    """Words with one blank before and after each; one blank if there is none."""
    return _BLANKS.sub(" ", f" {(text or '').translate(_ASCII)} ")


# --- payloads -----------------------------------------------------------------

def _matrix_tables() -> np.ndarray:
    """``[k, byte, value]``: what 2^k zero bytes make of a CRC register, by its bytes."""
    one = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0) for i in range(32)], np.uint64)
    out = np.zeros((32, 4, 256), np.uint64)
    bits = one
    for k in range(32):
        for byte in range(4):
            for i in range(8):
                on = (np.arange(256) >> i & 1).astype(bool)
                out[k, byte, on] ^= bits[8 * byte + i]
        bits = _shift(bits, out[k])
    return out


def _shift(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24 & 255])


@functools.cache
def _tables() -> np.ndarray:
    return _matrix_tables()


def compose(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of joined byte strings from the CRCs of their parts and the lengths of
    the right parts: the left CRC is moved over ``length`` zero bytes, bit by bit
    of the length, and added to the right one."""
    out, n, k = left.astype(np.uint64), length.astype(np.int64).copy(), 0
    while n.any():
        odd = (n & 1).astype(bool)
        out[odd] = _shift(out[odd], _tables()[k])
        n >>= 1
        k += 1
    return out ^ right.astype(np.uint64)


class Dictionary:
    """The automaton over delimiter-bounded words and their payloads."""

    def __init__(self, words: Iterable[str]):
        words = sorted({w for w in words if w and " " not in w and len(w.encode()) <= DICT_BYTES})
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(words):
            self.automaton.add_word(f" {w} ", k)
        self.automaton.make_automaton()
        raw = [w.encode() for w in words]
        self.crc = np.array([zlib.crc32(w) for w in raw], np.uint64)
        self.bytes = np.array([len(w) for w in raw], np.int64)
        self.chars = np.array([len(w) for w in words], np.int64)
        self.size = len(words)

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, CRC, bytes) of every word of a normalised text, in order."""
        flat = (np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64) if self.size
                else np.zeros(0, np.int64)).reshape(-1, 2)
        which = flat[:, 1]
        start, crc, size = flat[:, 0] - self.chars[which], self.crc[which], self.bytes[which]
        # Between two matches lies no more than the blank that they share.
        begins, ends = np.append(start, len(text)), np.insert(flat[:, 0], 0, 0)
        more = [(at.start(), at.group().encode()) for k in np.flatnonzero(begins > ends + 1)
                for at in _WORD.finditer(text, int(ends[k]), int(begins[k]))]
        if more:
            start = np.concatenate([start, np.array([s for s, _ in more], np.int64)])
            crc = np.concatenate([crc, np.array([zlib.crc32(w) for _, w in more], np.uint64)])
            size = np.concatenate([size, np.array([len(w) for _, w in more], np.int64)])
            order = np.argsort(start, kind="stable")
            start, crc, size = start[order], crc[order], size[order]
        return start, crc, size


_WORD = re.compile("[^ ]+")


def feature_buckets(texts: list[str | None], dictionary: Dictionary, n: int, buckets: int) -> list[np.ndarray]:
    """The buckets of every text's features: those of one word, then of two, ..."""
    norm = [normalised(t) for t in texts]
    # One scan for all: texts end and begin with a blank, so no word spans two.
    offset = np.concatenate([[0], np.cumsum([len(t) for t in norm])])
    start, crc, size = dictionary.scan("".join(norm))
    place = np.searchsorted(start, offset)
    own = [(crc % buckets).astype(np.int64)]
    run, blank = crc, np.full(len(crc), zlib.crc32(b" "), np.uint64)
    if n > 1:
        after = compose(blank, crc, size)
    for k in range(1, n):
        run = compose(run[:-1], after[k:], size[k:] + 1) if len(run) > 1 else run[:0]
        own.append((run % buckets).astype(np.int64))
    return [np.concatenate([own[k][a:max(a, b - k)] for k in range(n)]) for a, b in zip(place, place[1:])]


# --- distributed steps -----------------------------------------------------------

_BUILT: dict[int, tuple[object, Dictionary]] = {}
CACHES["resampling"] = _BUILT.clear


def _compiled(shared) -> Dictionary:
    """The automaton of this worker, built once for each broadcast."""
    if shared.value is not _BUILT.get(0, (None,))[0]:
        _BUILT[0] = (shared.value, Dictionary(shared.value))
    return _BUILT[0][1]


def dictionary_words(texts: DataFrame) -> list[str]:
    """The most frequent words of a sample of ``texts`` (column text)."""
    n = texts.count()
    if not n:
        return []
    sample = texts.filter(unit_hash(F.col("text")) < min(1.0, DICT_TEXTS / n))

    @in_task("resampling")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(w for w in normalised(text.as_py()).split(" ") if w and len(w.encode()) <= DICT_BYTES)
        top = seen.most_common(DICT_WORDS)
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())],
                              ["word", "n"])

    # Copies of a sampled text add counts, not words.
    top = (sample.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(DICT_WORDS))
    return [r["word"] for r in top.collect()]


def with_buckets(texts: DataFrame, words: list[str], keys: list[str], n: int, buckets: int) -> DataFrame:
    """``keys``, ``n_words``, ``n_features`` and ``packed``, the features' buckets as
    little-endian 32-bit numbers."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(words)
    names = [*keys, "n_words", "n_features", "packed"]

    @in_task("resampling")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = _compiled(shared)
        for batch in batches:
            for first, part in chunks(batch.column(len(keys)), CHUNK_BYTES):
                got = feature_buckets(part, dictionary, n, buckets)
                size = np.array([len(g) for g in got], np.int64)
                # All features of a text of w words: w + (w - 1) + ..., n terms at most.
                ones = np.array([_words_of(s, n) for s in size], np.int64)
                yield pa.record_batch([*(batch.column(k).slice(first, len(part)) for k in range(len(keys))),
                                       pa.array(ones), pa.array(size),
                                       pa.array([g.astype("<u4").tobytes() for g in got], pa.binary())], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema.fields),
                        "n_words bigint", "n_features bigint", "packed binary"])
    return texts.select(*keys, "text").mapInArrow(run, schema)


def _words_of(features: int, n: int) -> int:
    """Words of a text with so many features of 1 to n words."""
    w = 0
    while w < n and features > w * (w + 1) // 2:
        w += 1
    if features <= n * (n + 1) // 2:
        return w
    return (features + n * (n - 1) // 2) // n


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows of ``packed``: one array per task, added
    up by a partial aggregate; ``buckets`` numbers reach the driver."""
    @in_task("resampling")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = (packed.select("packed").mapInArrow(count, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares."""
    size, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + size) / (float(a + 1) * float(t + size))))
                     for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(h: int) -> float:
    """Thousandths of a standard Gumbel value from a 32-bit number."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(packed: DataFrame, gain: np.ndarray, id_col: str) -> DataFrame:
    shared = packed.sparkSession.sparkContext.broadcast(gain)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256),
                           1, 8), 16, 10).cast("bigint")
    kind = packed.schema[id_col].dataType.simpleString()

    @in_task("resampling")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            weight = []
            for raw in batch.column(4):
                at = np.frombuffer(raw.as_buffer(), "<u4")
                weight.append(int(g[at].sum()) // len(at) if len(at) else 0)
            score = [w + noise(x) for w, x in zip(weight, batch.column(3).to_pylist())]
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array(weight, pa.int64()),
                                   pa.array(score, pa.int64())], [id_col, "n_words", "n_features", "weight", "score"])

    return packed.select(id_col, "n_words", "n_features", h.alias("h"), "packed").mapInArrow(
        run, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3, ...) in ``order``: one range partitioning,
    then a row's place in its sorted partition plus the rows of earlier ones."""
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), f"{name}-rows")
    order = [*order, F.col("tie")]
    # The id holds the partition above bit 33 and the place in it below.
    parts = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                        .withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright(F.col("at"), 33)
    sizes = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition
    before = sizes.select("part", (F.coalesce(F.sum("n").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return (parts.withColumn("part", part).join(before, "part")
            .withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)
            .drop("at", "tie", "part", "before"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", n: int = WORDS_IN_FEATURE,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             draw: Callable[[int], int] = lambda rows: PERCENT * rows // 100) -> DataFrame:
    """Every row of ``docs`` (``id_col``, text) with ``n_features``, ``weight``,
    ``score`` and ``rank``: the rows whose features are likelier in ``target``
    (text) than in ``docs`` are drawn more often, without replacement; ``draw``
    gives how many of the rows with ``min_words`` words."""
    words = dictionary_words(target.select("text").unionByName(docs.select("text")))
    packed = materialise(with_buckets(docs, words, [id_col], n, buckets), "resample-buckets")
    goal = with_buckets(target.select(F.lit(0).alias("k"), "text"), words, ["k"], n, buckets)
    gain = gains(bucket_counts(packed, buckets), bucket_counts(goal, buckets))
    scored = materialise(_scored(packed, gain, id_col), "resample-scored")
    eligible = scored.filter(F.col("n_words") >= min_words)
    drawn = draw(eligible.count())
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last()]
    top = ranked(eligible, order, "resample").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return top.unionByName(rest).select(id_col, "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, target)
