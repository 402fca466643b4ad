"""What a micro-batch costs: files, tasks and bytes follow its rows, not the session's settings."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from vigil.operators import mute as M
from vigil.session import ADAPTIVE, each_batch, scratch_path
from vigil.streaming import ingest as ING
from vigil.streaming import runner as RUN

DATES = 3


def _messages(spark, n=600):
    rows = []
    for k in range(n):
        payload = {"check_name": f"c{k}", "output": "x|k=1", "status": "Warning",
                   "telegram_channels": [{"chat_id": "-1", "bot_token": "t"}],
                   "timestamp": f"2024-01-{1 + k % DATES:02d}T08:00:00Z"}
        rows.append((k, json.dumps(payload)))
    return spark.createDataFrame(rows, "msg_id long, payload string")


def _folder(path):
    return path.removeprefix("file:")


@pytest.mark.parametrize("window", [None, "1 hour"])
def test_a_batch_leaves_one_file_per_date(spark, window):
    base = scratch_path(spark, "files")
    _messages(spark).repartition(4).write.json(f"{base}/src")
    ING.start_ingest(spark, f"{base}/src", f"{base}/t", f"{base}/ckpt", max_files_per_trigger=2, window=window).awaitTermination()
    for table in ("check_result", "check_result_perf_data", "outbox"):
        for batch in (0, 1):
            files = glob.glob(f"{_folder(base)}/t/{table}/batch_id={batch}/*/*.parquet")
            assert len(files) == DATES, (table, batch)
        assert spark.read.parquet(f"{base}/t/{table}").count() == 600


@pytest.mark.parametrize("state", [False, True])
def test_jobs_of_a_batch_are_adaptive_and_the_stream_keeps_its_settings(spark, state):
    base, seen, held = scratch_path(spark, "adaptive"), [], []
    _messages(spark, 20).withColumn("at", F.current_timestamp()).repartition(2).write.json(f"{base}/src")

    def work(df, n):
        rows = df.groupBy("msg_id").count().persist()
        rows.count()
        seen.append(rows.rdd.getNumPartitions())
        rows.unpersist()

    def watched(df, n):
        session = df.sparkSession
        before = [session.conf.get(k) for k in ADAPTIVE]
        each_batch(work)(df, n)
        held.append((before, [session.conf.get(k) for k in ADAPTIVE]))

    stream = spark.readStream.schema("msg_id long, at timestamp").option("maxFilesPerTrigger", 1).json(f"{base}/src")
    if state:
        stream = stream.withWatermark("at", "1 hour").dropDuplicates(["msg_id", "at"])
    (stream.writeStream.option("checkpointLocation", f"{base}/ckpt").foreachBatch(watched)
     .trigger(availableNow=True).start().awaitTermination())
    assert len(seen) >= 2 and all(parts < int(spark.conf.get("spark.sql.shuffle.partitions")) for parts in seen)
    assert all(before == after for before, after in held)


def test_commands_meet_the_registry_once_and_without_the_driver(spark):
    names = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "check_name string")
    rows = [(1, "a", "mute", None), (2, "zz", "mute", "no-date"), (3, "b", "mute", "no-date"), (4, None, "unmute", None)]
    commands = spark.createDataFrame(rows, "seq long, check_name string, op string, until string")
    accepted, rejects = M.split_commands(names, commands)
    assert [r.seq for r in accepted.collect()] == [1]
    assert sorted((r.seq, r.reason) for r in rejects.collect()) == [(2, "unknown_check"), (3, "bad_until"), (4, "unknown_check")]
    plan = rejects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert "Broadcast" not in rejects._jdf.queryExecution().executedPlan().toString()


def test_functions_of_a_batch_run_once(spark):
    base, calls = scratch_path(spark, "once"), spark.sparkContext.accumulator(0)

    def count(pdf):
        calls.add(len(pdf))
        return pdf.assign(exit_code=0, output="fine")[["exit_code", "output"]]

    task = {"passive": False, "check_name": "a", "script": {"content": "s"}, "interval": 60, "secret_refs": None,
            "telegram_channels": [], "mute_notifications": False, "mute_notifications_until": None}
    batch = spark.createDataFrame([(1, json.dumps(task))], "msg_id long, payload string")
    inputs = spark.createDataFrame([("a", 4)], "check_name string, n long")
    secrets = spark.createDataFrame([], "secret_name string, key string, value binary")
    RUN.run_batch(batch, 0, base, inputs, secrets, {"s": count}.get)
    assert calls.value == 1
    assert spark.read.json(f"{base}/results").count() == 1 and spark.read.parquet(f"{base}/failures").count() == 0
