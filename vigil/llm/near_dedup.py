"""Near-duplicate detection by fast similarity sketches (operator 10).

Sketch. A document is the set of its distinct word shingles. Sketching makes
rounds of hashed bin placement: in each of the first ``t`` rounds every shingle
is thrown into one of ``t`` bins and a bin keeps its smallest value of the
first round that reached it; the next ``t`` rounds throw every shingle into
bin 0, 1, ... in turn, so that every coordinate fills. Work stops when all bins
are full, after about ``t log t / n`` rounds for ``n`` shingles. Two sets agree
in a coordinate with probability equal to their Jaccard similarity, with the
concentration of ``t`` independent trials.

Banding. ``BANDS`` bands of ``ROWS`` coordinates: a pair of similarity 0.8
shares no band with probability (1 - 0.8^5)^32, about 3e-6. Documents with one
and the same set are one class from the start.

Links. A bucket (band, value) may hold a third of all classes, so no bucket is
expanded into pairs. Members are compared with their bucket's leader (a
pseudo-random member), first in ``FIRST`` bands and then, where member and
leader are not yet in one component, in all of them. What is still apart inside
a bucket is then compared in full: members outside the bucket's largest
component against all members of other components, in blocks, each pair in the
first band that it shares. A bucket is cut into at most ``PARTS`` parts on either
side, until parts would outgrow a task: so up to ``PARTS * MOST_HEADS`` members a
member is written at most ``2 * PARTS`` times, whatever the bucket's size, and
beyond that n / ``MOST_HEADS`` + n / ``MOST_REST`` times. A block holds the sketches
of its heads and streams the others past them; it first finds which rows are in any
likely pair, in portions of ``BLOCK`` heads; then those rows alone get their sets,
and a portion reports the links that join components it still sees apart. So what
is written grows with the rows of the blocks, not with their pairs. A pair inside
one component changes no component.

Confirming. Members get a second, finer sketch of ``FINE`` one-byte
coordinates; pairs whose estimate lies almost five standard deviations below
0.8 are dropped, the others are confirmed on the full shingle sets, streamed
past each leader.

Defined results: a null, empty or white-space text has the empty set, size 0,
and is linked with nothing, not even another empty text; fewer than ``n`` words
make one shingle, the whole sequence; rows that share a ``doc_id`` are one
document per distinct set; a null ``doc_id`` is larger than any other, and a
group of null ids only is kept whole. Extra columns are ignored by
:func:`near_groups` and kept by :func:`drop_near`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import chunks, in_task, materialise, scratch, small_batches, unused
from vigil.llm.components import components

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
FIRST = 4       # bands of the first phase
FINE = 512      # coordinates of the members' second sketch
THRESHOLD = 80  # per cent
# Agreeing coordinates, two of 256 values also by chance, less 4.8 deviations.
SIEVE = int(FINE * (0.8 + 0.2 / 256) - 4.8 * (FINE * 0.8 * 0.2) ** 0.5)
# The same over the first coordinates alone, with over five deviations: one in 10^7
# of the pairs at 0.8 agrees less.
FRONT = 128
FRONT_SIEVE = 73
BLOCK = 256     # members of a leader, or heads of a bucket with their sets, that one block holds
REST = 1024     # members of a small bucket that a block compares with its heads
PARTS = 8       # parts of a bucket's heads, and of its members, until they outgrow these sizes:
MOST_HEADS, MOST_REST = 8192, 65536
PORTIONS = 64   # portions of a block's heads: MOST_HEADS / BLOCK, and as many to spare

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _B
    x = x ^ (x >> np.uint64(32))
    x = x * _B
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """word -> 64-bit hash; emptied when full, as it only saves time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, n: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. ``bytes.lower`` folds A-Z only and
    ``bytes.split`` cuts at space and \\x09-\\x0D only, as the contract has it."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    width = min(n, len(tokens))
    acc = np.full(len(tokens) - width + 1, width, np.uint64)
    for k in range(width):
        acc = _mix(acc * _A + h[k:len(h) - width + 1 + k])
    return np.unique(acc)


def sketch(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` 32-bit coordinates per (non-empty) set."""
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    todo = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    for r in range(2 * bins):
        if not len(todo):
            break
        flat = np.concatenate([sets[k] for k in todo])
        row = np.repeat(todo, [len(sets[k]) for k in todo])
        h = _mix(flat ^ np.uint64(int(_A) * (r + 1) & (1 << 64) - 1))
        # The round leads the value, so an earlier round always wins.
        value = (np.uint64(r) << np.uint64(40)) | (h >> np.uint64(24))
        at = ((h & np.uint64(0xFFFFFF)) * np.uint64(bins)) >> np.uint64(24) if r < bins else np.uint64(r - bins)
        np.minimum.at(out.reshape(-1), row * bins + at.astype(np.int64), value)
        if r >= bins - 1 or r % 4 == 3 or r < 2:
            todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(axis=1)]
    return (_mix(out) >> np.uint64(32)).astype("<u4")


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band; keys of different bands differ."""
    parts = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        acc = _mix(acc * _A + parts[:, :, k])
    return acc.view(np.int64)


SKETCH_SCHEMA = "doc_id long, n_shingles long, fp binary, keys array<long>"


def _fingerprint(shingle_set: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingle_set.astype("<u8").tobytes()) if len(shingle_set) else None


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    """A row per row of ``docs``; ``fp`` identifies the set (null when empty)."""

    @in_task("near")
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start, texts in chunks(batch.column(1)):
                sets = [shingles(t, n, words) for t in texts]
                keys = band_keys(sketch(sets))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_fingerprint(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()),
                                             pa.array(keys.ravel())),
                ], names=["doc_id", "n_shingles", "fp", "keys"])

    return docs.select("doc_id", "text").mapInArrow(make, SKETCH_SCHEMA)


def _classes(sketches: DataFrame) -> DataFrame:
    """One row per distinct set: ``rep`` (its number), ``fp, first_id, size,
    keys``. The numbers are fixed by writing them."""
    return materialise(
        sketches.filter(F.col("fp").isNotNull()).groupBy("fp")
        .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").cast("int").alias("size"),
             F.first("keys").alias("keys"))
        .withColumn("rep", F.monotonically_increasing_id()), "near-classes")


def _members(classes: DataFrame) -> DataFrame:
    """``bucket, band, rep, leader`` for every bucket that several classes share."""
    buckets = materialise(classes.select("rep", F.posexplode("keys").alias("band", "bucket")), "near-buckets")
    leaders = materialise(
        buckets.groupBy("bucket")
        .agg(F.min_by("rep", F.xxhash64("rep")).alias("leader"), F.count("*").alias("n"))
        .filter(F.col("n") > 1).select("bucket", "leader"), "near-leaders")
    return materialise(buckets.join(leaders, "bucket"), "near-members")


def _sets(docs: DataFrame, classes: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """``rep, size, keys, fine, shingles`` (sorted 64-bit hashes) of the classes
    in ``reps``, made from the texts of their first documents."""

    @in_task("near")
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                sets = [shingles(t, n, words) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    pa.array([_fingerprint(s) for s in sets], pa.binary()),
                    pa.array([r.astype(np.uint8).tobytes() for r in sketch(sets, FINE)], pa.binary()),
                    pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                ], names=["fp", "fine", "shingles"])

    wanted = materialise(classes.join(reps, "rep", "left_semi"), "near-wanted")
    # A table of its own, so that Spark knows how small the ids are.
    ids = materialise(wanted.select("first_id"), "near-ids")
    texts = docs.select("doc_id", "text").join(
        ids, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    made = texts.select("text").mapInArrow(make, "fp binary, fine binary, shingles binary")
    # Rows repeated in docs give a set twice; one stays.
    return materialise(made.join(wanted.select("rep", "fp", "size", "keys"), "fp").drop("fp")
                       .dropDuplicates(["rep"]), "near-sets")


def _by_leader(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) to rows (grp, block, role, id): the leader (role 0) and
    about ``BLOCK`` of its members (role 1) in each block."""
    many = materialise(pairs.groupBy("a").agg(F.count("*").alias("n")), "near-counts")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = many.select(F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
                      F.lit(0).alias("role"), F.col("a").alias("id"))
    rest = pairs.join(many, "a").select(
        F.col("a").alias("grp"), F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"),
        F.lit(1).alias("role"), F.col("b").alias("id"))
    return own.unionByName(rest)


def _streamed(rows: DataFrame, payload: DataFrame, compare, schema: str = "a long, b long") -> DataFrame:
    """Rows (grp, block, role, id, ...) with the payload of their id, each block
    in one task and its role 0 first, through ``compare``."""
    joined = rows.join(payload, rows["id"] == payload["rep"]).drop("rep")
    return (joined.repartition("grp", "block").sortWithinPartitions("grp", "block", "role")
            .mapInArrow(compare, schema))


def _pair_batch(left, right) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                                      names=["a", "b"])


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


BLOCK_ROW = "grp long, block long, role int, id long, label long, band int"


class _Blocks:
    """Walks rows sorted by (grp, block, role): ``heads`` are the rows of role 0
    of the block at hand, ``done`` is called with them when the block ends."""

    def __init__(self, done=None):
        self.at, self.heads, self.done = None, [], done

    def move(self, key: tuple) -> None:
        if key != self.at:
            self.close()
            self.at, self.heads = key, []

    def close(self) -> None:
        if self.at is not None and self.done:
            self.done(self.at, self.heads)


class _Rows:
    """The columns of a batch that the comparison of sketches needs."""

    def __init__(self, batch: pa.RecordBatch):
        self.grp, self.block, self.role, self.id, self.label, self.size, self.band = _columns(
            batch, "grp", "block", "role", "id", "label", "size", "band")
        self.fine = _fixed(batch.column("fine"), "u1", FINE)
        self.front = np.ascontiguousarray(self.fine[:, :FRONT])
        self.keys = np.asarray(batch.column("keys").flatten()).reshape(-1, BANDS)
        self.size = self.size.astype(np.int64)

    def head(self, k: int) -> tuple:
        return (self.id[k], self.size[k], self.label[k], self.keys[k].copy(), self.fine[k].copy())

    def likely(self, lo: int, hi: int, head: tuple) -> np.ndarray:
        """Rows from ``lo`` to ``hi`` that may link with the head: other label,
        fitting size, sketches that agree enough and, in a bucket (band 0 or
        more), no earlier band in common."""
        ident, size, label, keys, fine = head[:5]
        keep = (self.label[lo:hi] != label) & (self.id[lo:hi] != ident)
        keep &= 100 * np.minimum(self.size[lo:hi], size) >= THRESHOLD * np.maximum(self.size[lo:hi], size)
        some = lo + np.flatnonzero(keep)
        some = some[(self.front[some] == fine[:FRONT]).sum(axis=1) >= FRONT_SIEVE]
        some = some[(self.fine[some] == fine).sum(axis=1) >= SIEVE]
        if self.band[lo] >= 0:
            some = some[(self.keys[some] == keys).argmax(axis=1) == self.band[lo]]
        return some


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[place] == b).sum())
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of the runs of equal keys."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change)
    return zip(starts, np.append(starts[1:], len(change)))


@in_task("near")
def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The likely pairs of a leader (role 0) and its members (role 1)."""
    blocks = _Blocks()
    for batch in batches:
        rows, left, right = _Rows(batch), [], []
        for lo, hi in _runs(rows.grp, rows.block, rows.role):
            blocks.move((rows.grp[lo], rows.block[lo]))
            if rows.role[lo] == 0:
                blocks.heads += [rows.head(k) for k in range(lo, hi)]
                continue
            for head in blocks.heads:
                found = rows.id[rows.likely(lo, hi, head)]
                left.append(np.full(len(found), head[0]))
                right.append(found)
        if left:
            yield _pair_batch(np.concatenate(left), np.concatenate(right))


@in_task("near")
def _likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of bucket blocks that are in a likely pair, once in each portion
    of the block's heads; the portion becomes part of the block's number."""
    out: list[tuple] = []

    def portion(head: int) -> int:
        return min(head // BLOCK, PORTIONS - 1)

    def done(at: tuple, heads: list) -> None:
        grp, block = at
        out.extend((grp, block * PORTIONS + portion(k), 0, heads[k][0], heads[k][2], heads[k][5]) for k in sorted(used))
        used.clear()

    used: set = set()
    blocks = _Blocks(done)

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 6
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=["grp", "block", "role", "id", "label", "band"])

    for batch in batches:
        rows = _Rows(batch)
        for lo, hi in _runs(rows.grp, rows.block, rows.role):
            blocks.move((rows.grp[lo], rows.block[lo]))
            if rows.role[lo] == 0:
                blocks.heads += [(*rows.head(k), rows.band[k]) for k in range(lo, hi)]
                continue
            grp, block = blocks.at
            hits: dict[int, set] = {}
            for at, head in enumerate(blocks.heads):
                some = rows.likely(lo, hi, head)
                if len(some):
                    hits.setdefault(portion(at), set()).update(some.tolist())
                    used.add(at)
            out.extend((grp, block * PORTIONS + part, 1, rows.id[k], rows.label[k], rows.band[k])
                       for part, found in hits.items() for k in sorted(found))
        yield flush()
    blocks.close()
    yield flush()


@in_task("near")
def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a block's heads and members, confirmed on the full sets, that
    join components which the block's earlier links have not joined."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    blocks = _Blocks(lambda at, heads: parent.clear())
    for batch in batches:
        rows, left, right = _Rows(batch), [], []
        sets = batch.column("shingles")
        for lo, hi in _runs(rows.grp, rows.block, rows.role):
            blocks.move((rows.grp[lo], rows.block[lo]))
            if rows.role[lo] == 0:
                blocks.heads += [(*rows.head(k), np.frombuffer(sets[k].as_buffer(), "<u8").copy())
                                 for k in range(lo, hi)]
                continue
            for head in blocks.heads:
                for k in rows.likely(lo, hi, head):
                    one, two = find(head[2]), find(rows.label[k])
                    if one != two and _linked(head[5], np.frombuffer(sets[k].as_buffer(), "<u8")):
                        parent[one] = two
                        left.append(head[0])
                        right.append(rows.id[k])
        yield _pair_batch(left, right)


@in_task("near")
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a leader and its members whose full sets reach the threshold."""
    lead = np.empty(0, np.uint64)
    for batch in batches:
        grp, role, ident = _columns(batch, "grp", "role", "id")
        left, right = [], []
        for k, raw in enumerate(batch.column("shingles")):
            mine = np.frombuffer(raw.as_buffer(), "<u8")
            if role[k] == 0:
                lead = mine.copy()
            elif _linked(lead, mine):
                left.append(grp[k])
                right.append(ident[k])
        yield _pair_batch(left, right)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return materialise(_streamed(_by_leader(pairs), sets.select("rep", "shingles"), _confirm), "near-links")


def _sketch_payload(sets: DataFrame) -> DataFrame:
    return sets.select("rep", "size", "keys", "fine")


def _leader_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among pairs (leader, member)."""
    pairs = materialise(pairs.distinct(), "near-pairs")
    rows = _by_leader(pairs).withColumns({"label": F.col("id"), "band": F.lit(-1)})
    return _confirmed(materialise(_streamed(rows, _sketch_payload(sets), _sieve), "near-sieved"), sets)


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the label of their component (their own number if none)."""
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep"))


def bucket_blocks(named: DataFrame) -> DataFrame:
    """Rows (grp, block, role, id, label, band) of the buckets where several
    components meet: the members outside the largest one are heads (role 0), all
    members the rest (role 1); each head meets each member in one block."""
    per_label = materialise(named.groupBy("bucket", "label").agg(F.count("*").alias("n")), "near-per-label")

    def parts(n, few: int, most: int):
        return F.greatest(F.least(F.ceil(n / few), F.lit(PARTS)), F.ceil(n / most))

    heads = parts(F.col("n") - F.col("most"), BLOCK, MOST_HEADS)
    rest = parts(F.col("n"), REST, MOST_REST)
    mixed = materialise(
        per_label.groupBy("bucket")
        .agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels"),
             F.sum("n").alias("n"), F.max("n").alias("most"))
        # Two members: the leader and one that it has been compared with.
        .filter((F.col("labels") > 1) & (F.col("n") > 2))
        .select("bucket", "top", heads.cast("int").alias("n_heads"), rest.cast("int").alias("n_rest")), "near-mixed")
    apart = named.join(mixed, "bucket")

    def block(role: int, own: str, other: str) -> DataFrame:
        # Heads are repeated for each part of the rest, the rest for each part of the heads.
        mine = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int")
        spread = apart.select("bucket", "rep", "label", "band", "top", "n_heads", "n_rest", mine.alias("mine"),
                              F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
        head, tail = ("mine", "other") if role == 0 else ("other", "mine")
        return spread.filter((F.col("label") != F.col("top")) | F.lit(role == 1)).select(
            F.col("bucket").alias("grp"), (F.col(head).cast("long") * F.col("n_rest") + F.col(tail)).alias("block"),
            F.lit(role).alias("role"), F.col("rep").alias("id"), "label", "band")

    return block(0, "n_heads", "n_rest").unionByName(block(1, "n_rest", "n_heads"))


def _other_links(named: DataFrame, sets: DataFrame) -> DataFrame:
    """Links in buckets where several components meet."""
    rows = bucket_blocks(named)
    likely = materialise(_streamed(rows, _sketch_payload(sets), _likely_rows, BLOCK_ROW), "near-likely")
    return materialise(_streamed(likely, sets, _block_links), "near-links")


def _all_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between classes that connect whatever all links connect."""
    pair = [F.col("leader").alias("a"), F.col("rep").alias("b")]
    links = _leader_links(members.filter((F.col("band") < FIRST) & (F.col("rep") != F.col("leader")))
                          .select(*pair), sets)
    labels = components(links)
    of_leader = labels.select(F.col("node").alias("leader"), F.col("label").alias("lead_label"))
    apart = (_named(members, labels).join(of_leader, "leader", "left")
             .filter(F.col("label") != F.coalesce("lead_label", "leader")).select(*pair))
    links = links.unionByName(_leader_links(apart, sets))
    named = materialise(_named(members, components(links)), "near-named")
    return links.unionByName(_other_links(named, sets))


def near_groups(docs: DataFrame, n: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, n_shingles, fp,
    component_id, kept`` for shingles of ``n`` words; ``component_id`` is the
    smallest doc_id reachable by links."""
    with small_batches(docs.sparkSession):
        rows = materialise(_sketches(docs, n), "near-sketches")
        classes = _classes(rows)
        members = _members(classes)
        reps = materialise(members.select("rep").distinct(), "near-reps")
        links = _all_links(members, _sets(docs, classes, reps, n))
    labels = components(links).withColumnRenamed("node", "rep")
    of_class = materialise(classes.join(labels, "rep", "left").select(
        "fp", "first_id", F.coalesce("label", "rep").alias("label")), "near-of-class")
    smallest = materialise(of_class.groupBy("label").agg(F.min("first_id").alias("component_id")),
                           "near-smallest")
    named = materialise(of_class.join(smallest, "label").select("fp", "component_id"), "near-final")
    narrow = rows.select("doc_id", "n_shingles", "fp")
    comp = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return narrow.join(named, "fp", "left").select(
        "doc_id", "n_shingles", "fp", comp.alias("component_id"),
        F.col("doc_id").eqNullSafe(comp).alias("kept"))


def drop_near(docs: DataFrame, n: int = 5) -> DataFrame:
    """``docs`` without the rows of a group whose smallest ``doc_id`` another
    row has; all columns stay. Rows that share a ``doc_id`` stay or go as the
    groups of their texts say: an id goes only where none of its texts is kept."""
    (gone,) = unused(docs, "gone")
    with scratch(docs.sparkSession) as inner:
        groups = near_groups(docs, n)
        dropped = inner.keep(materialise(
            groups.groupBy("doc_id").agg(F.max("kept").alias("any_kept"))
            .filter(~F.col("any_kept")).select(F.col("doc_id").alias(gone)), "near-gone"))
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(gone)), "left_anti")
