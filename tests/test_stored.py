"""Stored tables under compaction: ingest, compact, ingest again, replay."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vigil.schemas import CHECK_RESULT
from vigil.session import scratch_path
from vigil.sinks import stored as ST
from vigil.sinks import tables as TB
from vigil.streaming import ingest as ING

MESSAGES = "msg_id long, payload string"


def _message(check, ts, output="x|k=1"):
    return ('{"check_name":"%s","output":"%s","status":"Ok","telegram_channels":[],"timestamp":"%s"}'
            % (check, output, ts))


def _batch(spark, *rows):
    return spark.createDataFrame([(k, _message(*r)) for k, r in rows], MESSAGES)


def _files(path):
    local = path.replace("file:", "", 1)
    return sum(f.endswith(".parquet") for _, _, names in os.walk(local) for f in names)


def _rows(spark, path):
    return sorted((r.check_name, r.timestamp, r.batch_id) for r in ST.read_stored(spark, path, CHECK_RESULT).collect())


@pytest.fixture()
def table(spark):
    """Four batches; each repeats a message of the one before."""
    base = scratch_path(spark, "stored")
    batches = [_batch(spark, (10 * k, (f"c{k}", f"2024-01-0{1 + k % 2}T00:00:00Z")),
                      (10 * k + 1, (f"c{k - 1}", f"2024-01-0{1 + (k - 1) % 2}T00:00:00Z")),
                      (10 * k + 2, ("same", f"2024-01-01T00:00:0{k}Z"))) for k in range(4)]
    return base, f"{base}/check_result", batches


def test_ingest_compact_ingest_replay(spark, table):
    base, path, batches = table
    plain = scratch_path(spark, "plain")
    for k, b in enumerate(batches):
        ING.process_batch(b, k, plain)
    want = _rows(spark, f"{plain}/check_result")
    for k in (0, 1):
        ING.process_batch(batches[k], k, base)
    before = _files(path)
    assert ST.last_done(spark, base) == 1
    first = ST.compact_stored(spark, path, CHECK_RESULT, 1)
    assert (first.version, first.upto, len(first.folders)) == (1, 1, 1)
    assert ST.compact_stored(spark, path, CHECK_RESULT, 1) == first       # nothing new, nothing done
    assert _rows(spark, path) == [r for r in want if r[2] < 2]            # before the old folders go ...
    assert ST.vacuum(spark, path) == 2
    assert _rows(spark, path) == [r for r in want if r[2] < 2]            # ... and after
    assert _files(path) + _files(f"{path}.compacted") < before
    for k in (2, 3):
        ING.process_batch(batches[k], k, base)
    assert _rows(spark, path) == want
    for k in (0, 1, 3):                                                   # replays of old batches and of the last
        ING.process_batch(batches[k], k, base)
        assert _rows(spark, path) == want
    rejected = spark.read.parquet(f"{base}/quarantine").select("msg_id", "reason")
    assert sorted(map(tuple, rejected.collect())) == [(k, "duplicate") for k in (11, 21, 31)]
    whole = ST.compact_stored(spark, path, CHECK_RESULT, 3, whole=True)
    assert (whole.version, whole.upto, len(whole.folders)) == (2, 3, 1)
    ST.vacuum(spark, path)
    assert _rows(spark, path) == want and _files(path) == 0


def test_of_two_compactions_one_commits(spark, table, monkeypatch):
    base, path, batches = table
    for k in (0, 1):
        ING.process_batch(batches[k], k, base)
    want, inner = _rows(spark, path), ST.compact

    def late(rows, folder):
        """Another compaction commits while this one writes."""
        monkeypatch.setattr(ST, "compact", inner)
        ST.compact_stored(spark, path, CHECK_RESULT, 1)
        inner(rows, folder)

    monkeypatch.setattr(ST, "compact", late)
    with pytest.raises(ST.CommitConflict):
        ST.compact_stored(spark, path, CHECK_RESULT, 1)
    assert ST.manifest(spark, path).version == 1 and _rows(spark, path) == want
    assert ST.vacuum(spark, path) == 3                                    # two batches, the folder that lost
    assert _rows(spark, path) == want


def test_catalog_follows_the_manifest(spark, table):
    base, path, batches = table
    TB.create_tables(spark, base, "vigil_compacted")
    for k, b in enumerate(batches):
        ING.process_batch(b, k, base)
        if k == 1:
            ST.compact_stored(spark, path, CHECK_RESULT, 1)
    for _ in range(2):
        ST.register_stored(spark, "vigil_compacted.check_result", path)
        got = spark.table("vigil_compacted.check_result").select("check_name", "timestamp")
        assert sorted(map(tuple, got.collect())) == [r[:2] for r in _rows(spark, path)]
        ST.vacuum(spark, path)


def test_odd_dates_neither_stop_the_stream_nor_widen_the_read(spark):
    """Years 1 and 999 are valid times; one old message must not make a batch read
    all days in between."""
    base = scratch_path(spark, "odd")
    path = f"{base}/check_result"
    days = [f"2024-01-{d:02d}T00:00:00Z" for d in range(1, 21)]
    ING.process_batch(_batch(spark, *[(k, ("a", t)) for k, t in enumerate(days)]), 0, base)
    odd = [(100, ("a", "0001-01-01T00:00:00Z")), (101, ("a", "0999-01-01T00:00:00Z")), (102, ("a", days[0])),
           (103, ("a", "9999-12-31T23:59:59Z"))]
    for _ in range(2):
        ING.process_batch(_batch(spark, *odd), 1, base)
        got = ST.read_stored(spark, path, CHECK_RESULT).filter("batch_id = 1").select(F.col("timestamp").cast("string"))
        assert sorted(r[0] for r in got.collect()) == ["0001-01-01 00:00:00", "0999-01-01 00:00:00", "9999-12-31 23:59:59"]
    rows = ING._decoded(_batch(spark, *odd[:3]), None).persist()
    prior = ING._stored_keys(rows, path, 1)
    assert prior.collect()[0].event_date == dt.date(2024, 1, 1)
    plan = prior._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan, plan
    rows.unpersist()


def test_reading_before_anything_is_stored(spark):
    assert ST.read_stored(spark, scratch_path(spark, "none"), CHECK_RESULT).collect() == []
