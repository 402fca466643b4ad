"""The worker as a stream: what fails, what repeats, what is published."""

import json

import pytest
from pyspark.sql import functions as F

from vigil.operators import schedule as S
from vigil.operators.decode import decode_results
from vigil.session import scratch_path
from vigil.sinks.stored import publish_batch
from vigil.sources.tables import read_payloads
from vigil.streaming import runner as RUN

MESSAGES = "msg_id long, payload string"


def _task(check, script, refs=None, mute=False):
    return json.dumps({"passive": False, "check_name": check, "script": script and {"content": script}, "interval": 60,
                       "secret_refs": refs, "telegram_channels": [{"chat_id": "7", "channel_name": "ch"}],
                       "mute_notifications": mute, "mute_notifications_until": None})


def _find():
    """The functions as closures: workers cannot import this file."""
    import pandas as pd

    def count(pdf):
        return pd.DataFrame({"exit_code": [1] * len(pdf),
                             "output": [f"{n}|secrets={0 if s is None else len(s)}" for n, s in zip(pdf["n"], pdf["secrets"])]})

    def odd(pdf):
        if (pdf["n"] % 2 == 1).any():
            raise ValueError("odd")
        return count(pdf)

    return {"count": count, "odd": odd}.get


FIND = _find()


@pytest.fixture()
def world(spark):
    tasks = [(1, _task("a", "count", ["s", "none"])), (2, _task("a", "count")), (3, _task("b", "odd")),
             (4, _task("c", "odd", mute=True)), (5, _task("d", "count")), (6, _task("a", None)), (7, _task("a", "unknown")),
             (8, "{}")]
    inputs = spark.createDataFrame([("a", 4), ("b", 3), ("c", 2)], "check_name string, n long")
    secrets = spark.createDataFrame([("s", "k", bytearray(b"v")), ("s", "l", bytearray(b"w"))],
                                    "secret_name string, key string, value binary")
    return spark.createDataFrame(tasks, MESSAGES), inputs, secrets, scratch_path(spark, "runner-test")


def _published(spark, base):
    good, bad = decode_results(read_payloads(spark, f"{base}/results"))
    assert bad.count() == 0
    return sorted((r.msg_id, r.check_name, r.status, r.output, r.telegram_channels[0].chat_id, r.mute_notifications)
                  for r in good.collect())


WANT = [(1, "a", "Warning", "4|secrets=2", "7", False), (2, "a", "Warning", "4|secrets=0", "7", False),
        (4, "c", "Warning", "2|secrets=0", "7", True)]


def test_one_batch_and_its_replay(spark, world):
    batch, inputs, secrets, base = world
    for stamp in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):  # the replay runs later: the first results stay
        RUN.run_batch(batch, 0, base, inputs, secrets, FIND, stamp)
        assert _published(spark, base) == WANT
        good, _ = decode_results(read_payloads(spark, f"{base}/results"))
        assert {str(r.timestamp) for r in good.collect()} == {"2024-01-01 00:00:00"}
    failed = spark.read.parquet(f"{base}/failures").select("msg_id", "error").collect()
    assert sorted(map(tuple, failed)) == [(3, "ValueError"), (5, "no_input"), (6, "no_script"), (7, "no_script")]
    assert [r.msg_id for r in spark.read.parquet(f"{base}/rejects").collect()] == [8]


def test_a_follower_of_the_sink_sees_each_result_once(spark, world):
    """Batches fail after their publication; what they published is not published again."""
    batch, inputs, secrets, base = world
    for k in range(2):
        batch.filter(F.col("msg_id") % 2 == k).coalesce(1).write.mode("append").json(f"{base}/tasks")
    write = RUN.write_folder
    failures = iter([RuntimeError("lost"), None, RuntimeError("lost"), None, None, None, None, None])

    def once(df, path):
        if (e := next(failures, None)) is not None:
            raise e
        write(df, path)

    RUN.write_folder = once
    try:
        for _ in range(3):
            q = RUN.start_runner(spark, f"{base}/tasks", base, f"{base}/ckpt", inputs, secrets, FIND, max_files_per_trigger=1)
            try:
                q.awaitTermination()
            except Exception:  # noqa: BLE001 - the stream stops as the batch failed
                pass
            follow = (read_payloads(spark, f"{base}/results", stream=True).writeStream.format("parquet")
                      .option("path", f"{base}/seen").option("checkpointLocation", f"{base}/seen-ckpt")
                      .trigger(availableNow=True).start())
            follow.awaitTermination()
    finally:
        RUN.write_folder = write
    assert _published(spark, base) == WANT
    seen = spark.read.schema(MESSAGES).parquet(f"{base}/seen")
    assert sorted(r.msg_id for r in seen.collect()) == [1, 2, 4]


def test_publishing_tasks_again_adds_none(spark):
    path = scratch_path(spark, "publish")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], MESSAGES)
    assert S.publish(rows, path, "2024-01-01") and not S.publish(rows, path, "2024-01-01")
    assert publish_batch(rows.limit(0), path, 9)
    assert read_payloads(spark, path).count() == 2


def test_times_are_parsed_with_one_regular_expression(spark):
    from vigil.functions.validate import parse_rfc3339
    plan = (spark.range(3).select(F.col("id").cast("string").alias("t")).select(parse_rfc3339(F.col("t")).alias("ts"))
            ._jdf.queryExecution().optimizedPlan().toString())
    assert plan.count("RLIKE") == 1 and "regexp_extract" not in plan
