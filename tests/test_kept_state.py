"""State that streams keep: merged tables, the as-of join of two feeds, a registry
that starts from a scan, retention by whole chunks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import mute as M
from vigil.operators import registry as REG
from vigil.schemas import CHECK_RESULT
from vigil.session import scratch_path
from vigil.sinks import merged as MG
from vigil.sinks import stored as ST
from vigil.sinks import tables as TB
from vigil.streaming import asof as ASOF
from vigil.streaming import current as CUR
from vigil.streaming import ingest as ING

COMMAND = "seq long, check_name string, op string, until string"
REGISTRY = "check_name string, mute boolean, mute_until timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def _at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def registry(spark):
    rows = [("a", False, None), ("b", True, _at(5)), ("c", None, None), ("untouched", True, _at(9))]
    return spark.createDataFrame(rows, REGISTRY)


def _commands(rng, n=60):
    out = []
    for seq in range(n):
        op = rng.choice(["mute", "mute", "unmute"])
        until = rng.choice([None, f"2024-02-{1 + seq % 28:02d}T00:00:00Z", "soon"]) if op == "mute" else None
        out.append((seq, rng.choice(["a", "b", "c", "unknown"]), op, until))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mute_state_is_the_same_under_any_split(spark, registry, seed):
    rng = random.Random(seed)
    commands = _commands(rng)
    whole = spark.createDataFrame(commands, COMMAND)
    accepted, rejects = M.split_commands(registry, whole)
    want = sorted(map(repr, M.mute_state(registry, accepted).collect()))
    base = scratch_path(spark, "mutes")
    rng.shuffle(commands)
    cuts = [0, *sorted(rng.sample(range(61), 3)), 60]
    batches = [spark.createDataFrame(commands[a:b], COMMAND) for a, b in zip(cuts, cuts[1:])]
    for k, batch in enumerate(batches):
        CUR.mute_batch(batch, k, base, lambda: registry)
        if k == 1:
            MG.fold(spark, f"{base}/mutes", M.EFFECT, M.merge_effects, ST.last_done(spark, base))
    for k in (0, 3):                              # a folded batch and a live one run again
        CUR.mute_batch(batches[k], k, base, lambda: registry)
    assert sorted(map(repr, CUR.muted_now(spark, base, registry).collect())) == want
    ST.vacuum(spark, f"{base}/mutes")
    assert sorted(map(repr, CUR.muted_now(spark, base, registry).collect())) == want
    got = spark.read.parquet(f"{base}/rejects").select("seq", "check_name", "reason").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rejects.collect()))


def test_no_command_leaves_the_declared_state(spark, registry):
    base = scratch_path(spark, "mutes")
    CUR.mute_batch(spark.createDataFrame([], COMMAND), 0, base, lambda: registry)
    got = {r.check_name: (r.muted, r.muted_until, r.n_commands) for r in CUR.muted_now(spark, base, registry).collect()}
    assert got == {"a": (False, None, 0), "b": (True, _at(5), 0), "c": (None, None, 0), "untouched": (True, _at(9), 0)}


def _results(spark, *rows):
    lines = [(k, json.dumps({"check_name": c, "output": o, "status": s, "telegram_channels": [],
                             "timestamp": f"{_at(h).isoformat()}Z"})) for k, (c, h, s, o) in enumerate(rows)]
    return spark.createDataFrame([*lines, (99, "{}")], "msg_id long, payload string")


def test_late_older_results_change_nothing(spark):
    base = scratch_path(spark, "latest")
    batches = [_results(spark, ("a", 5, "Ok", "five|k=1"), ("a", 4, "Critical", "four")),
               _results(spark, ("a", 3, "Critical", "late"), ("b", 1, "Warning", "one")),
               _results(spark, ("b", 2, "CheckError", "two"), ("b", 2, "Ok", "two"))]

    def now():
        return {r.check_name: (r.timestamp, r.status, r.output) for r in CUR.latest_results(spark, base).collect()}

    CUR.latest_batch(batches[0], 0, base)
    assert now() == {"a": (_at(5), 0, "five")}
    CUR.latest_batch(batches[1], 1, base)
    assert now() == {"a": (_at(5), 0, "five"), "b": (_at(1), 1, "one")}
    path = f"{base}/latest"
    assert len(ST.manifest(spark, path).folders) == 0
    for upto in (0, 1):
        MG.fold(spark, path, CUR.LATEST, CUR.R.latest_all, upto)
        ST.vacuum(spark, path)
    assert len(ST.manifest(spark, path).folders) == 1
    assert spark.read.parquet(ST.manifest(spark, path).folders[0]).count() == 2     # a row per check, not per batch
    CUR.latest_batch(batches[2], 2, base)
    CUR.latest_batch(batches[0], 0, base)
    assert now() == {"a": (_at(5), 0, "five"), "b": (_at(2), 3, "two")}


def _both(spark, results, versions):
    r = spark.createDataFrame([(i, c, None if h is None else _at(h), "Critical") for i, c, h in results], ASOF.RESULT)
    v = spark.createDataFrame([(c, s, None if h is None else _at(h), s % 2 == 0, None) for c, s, h in versions], ASOF.VERSION)
    return (r.withColumn("_kind", F.lit("result"))
            .unionByName(v.withColumn("_kind", F.lit("version")), allowMissingColumns=True))


def _answers(spark, base, waiting):
    return sorted((r.event_id, r.version_seq) for r in ASOF.asof_so_far(spark, base, waiting).collect())


def test_results_wait_for_versions_that_are_late(spark):
    base, window = scratch_path(spark, "asof"), 2 * 3600
    steps = [_both(spark, [(1, "a", 5), (2, "a", 1), (3, "none", 1), (4, "a", None)], [("a", 10, 0), ("b", 11, 3)]),
             _both(spark, [(5, "b", 2)], [("a", 12, 4), ("b", 13, 6), ("a", 14, None)]),
             _both(spark, [(6, "a", 1), (7, "a", 4.5), (8, "b", 20)], [("a", 15, 7.5), ("b", 16, 1)]),
             _both(spark, [], [])]
    settled = [[(2, 10), (3, None), (4, None)], [(5, None)], [(1, 12), (6, 10), (7, 12)], []]
    done = []
    for k, step in enumerate(steps):
        ASOF.asof_batch(step, k, base, window)
        done = sorted([*done, *settled[k]], key=str)
        assert sorted(_answers(spark, base, False), key=str) == done
        if k in (1, 2):                           # the last batch again
            ASOF.asof_batch(step, k, base, window)
            assert sorted(_answers(spark, base, False), key=str) == done
    assert (8, 13) in _answers(spark, base, True)
    late = spark.read.parquet(f"{base}/late_versions").collect()
    assert [r.version_seq for r in late] == [16]
    kept = ASOF._slots(spark, base, 3)[1]
    assert sorted((r.check_name, r.version_seq) for r in kept.collect()) == [("a", 12), ("a", 15), ("b", 11), ("b", 13)]


@pytest.mark.parametrize("seed", [3, 4])
def test_streamed_asof_is_the_batch_join(spark, seed):
    rng = random.Random(seed)
    hours = 60
    versions = [(rng.choice("ab"), s, rng.randrange(hours)) for s in range(80)]
    results = [(i, rng.choice("abc"), rng.randrange(hours)) for i in range(150)]
    # Versions come at most 5 hours late, results at any time after they are due.
    v_slot = [(h + rng.randrange(5)) // 20 for _, _, h in versions]
    r_slot = [min(3, h // 20 + rng.choice([0, 0, 1, 2])) for _, _, h in results]
    base = scratch_path(spark, "asof")
    for k in range(4):
        ASOF.asof_batch(_both(spark, [r for r, s in zip(results, r_slot) if s == k],
                              [v for v, s in zip(versions, v_slot) if s == k]), k, base, 5 * 3600)
    want = sorted((i, max(((h, s) for c, s, h in versions if c == check and h <= at), default=(0, None))[1])
                  for i, check, at in results)
    assert _answers(spark, base, True) == want
    assert 0 < len(_answers(spark, base, False)) < len(want)


CHANGE = "seq long, op string, check_name string, mute boolean"


@pytest.mark.parametrize("start", [0, 3, 6])
def test_a_scan_and_an_overlapping_feed(spark, start):
    """The feed's overlap holds an older form of a check and one removed since."""
    events = [(1, "AddOrUpdate", "gone", False), (2, "AddOrUpdate", "a", False), (3, "AddOrUpdate", "b", False),
              (4, "Remove", "gone", None), (5, "AddOrUpdate", "a", True), (6, "AddOrUpdate", "c", False),
              (7, "Remove", "b", None), (8, "AddOrUpdate", "gone", True), (9, "AddOrUpdate", "c", True)]
    fence = 6
    feed = spark.createDataFrame(events, CHANGE)
    want = sorted((r.check_name, r.mute) for r in REG.fold_changes(feed).collect())
    scan = REG.fold_changes(feed.filter(F.col("seq") <= fence)).drop("seq")       # scans need not bear numbers
    path = scratch_path(spark, "seeded")
    ING.seed_registry(scan, fence, path)
    rest = [e for e in events if e[0] > start]
    for order in (rest, rest[::-1]):
        assert sorted((r.check_name, r.mute) for r in
                      REG.fold_changes(REG.after_scan(scan, fence, spark.createDataFrame(order, CHANGE))).collect()) == want
    for k, part in enumerate((rest[1::2], rest[::2])):
        ING.fold_registry_batch(spark.createDataFrame(part, CHANGE), k, path)
    assert sorted((r.check_name, r.mute) for r in ING.registry_state(spark, path).collect()) == want


def test_chunks_go_as_wholes(spark):
    base = scratch_path(spark, "chunks")
    path = f"{base}/check_result"
    # 1970-01-01 + 2817 weeks is 2023-12-28: chunks start on 28 Dec, 4, 11 and 18 January.
    days = [dt.datetime(2023, 12, 28), dt.datetime(2024, 1, 3, 23), dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 10, 23),
            dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 20)]
    rows = spark.createDataFrame([("a", t, 0, "x", t.date()) for t in days],
                                 "check_name string, timestamp timestamp_ntz, status short, output string, event_date date")
    TB.write_batch(rows, path, 0)
    ST.compact_stored(spark, path, CHECK_RESULT, 0)
    ST.vacuum(spark, path)
    TB.write_batch(rows, path, 1)

    def left():
        return sorted(r.timestamp for r in ST.read_stored(spark, path, CHECK_RESULT).collect())

    assert ST.drop_chunks(spark, path, "2024-01-17 23:59:59") == [2817]       # the second chunk ends a second later
    assert left() == sorted(2 * days[2:])
    assert ST.drop_chunks(spark, path, "2024-01-18 00:00:00") == [2818]
    assert left() == sorted(2 * days[4:])
    assert ST.drop_chunks(spark, path, "2024-01-18 00:00:00") == []
