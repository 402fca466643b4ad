"""The worker as a stream (A5, L1-L3, K4, K5): tasks are decoded, the function of
each task's script is run on the rows it reads, and results are published.

One micro-batch is one publication: its messages are written aside and appear in
the sink by one rename of a folder that bears the batch's number. A replayed
batch finds its folder and publishes nothing, so readers of the sink see each
result once, whether a batch failed before or after its publication. Offsets of
the task stream live in the checkpoint: a task is done when its results are out.

Channels and mute state come from the task, as they were when it was published.
A task without a script, without rows to read, or whose function fails gives no
result message; it is stored with its error under ``failures``. Tasks that do not
decode go to ``rejects``. Both are folders of the batch, replaced by a replay.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import status
from vigil.operators import checks as CK
from vigil.operators.decode import decode_tasks, encode_result
from vigil.operators.registry import merge_secrets
from vigil.session import each_batch
from vigil.sinks.stored import publish_batch
from vigil.sinks.tables import write_folder
from vigil.sources.tables import read_payloads

Function = Callable[[pd.DataFrame], pd.DataFrame]


class _Lookup:
    """Functions by script text; a task without a script has none."""

    def __init__(self, find: Callable[[str], Function | None]):
        self._find = find

    def get(self, script):
        return None if script is None or script != script else self._find(script)


def with_secrets(tasks: DataFrame, secrets: DataFrame) -> DataFrame:
    """``tasks`` (key, secret_refs) with ``secrets``, the map that their names stand
    for (L2); null where a task names none."""
    merged = (merge_secrets(tasks.select(F.col("key").alias("check_name"), "secret_refs"), secrets)
              .groupBy("check_name").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("secrets")))
    return tasks.join(merged.withColumnRenamed("check_name", "key"), "key", "left")


def run_tasks(tasks: DataFrame, inputs: DataFrame, secrets: DataFrame,
              find: Callable[[str], Function | None]) -> DataFrame:
    """Decoded tasks with what their functions gave: exit_code, output, error.
    ``inputs`` has one row per check: check_name and the columns that functions read;
    ``find`` gives the function of a script's text."""
    tasks = tasks.withColumn("key", F.concat_ws("\u0001", F.col("msg_id").cast("string"), "check_name"))
    read = with_secrets(tasks, secrets).join(inputs.withColumn("_read", F.lit(True)), "check_name", "left")
    # The checks are told apart by task: a check may be due several times in a batch.
    rows = (read.filter("_read").withColumn("check_name", F.col("key"))
            .select("check_name", F.col("script_content").alias("script_ref"), "secrets",
                    *[c for c in inputs.columns if c != "check_name"]))
    done = CK.script_checks(rows, _Lookup(find)).withColumnRenamed("check_name", "key")
    return tasks.join(done, "key", "left").withColumn(
        "error", F.when(F.col("error").isNull() & F.col("exit_code").isNull(), "no_input").otherwise(F.col("error")))


def outcomes(out: DataFrame, as_of: str | None = None):
    """(messages (msg_id, payload), failures (msg_id, check_name, error, message)) of
    tasks that have been run."""
    channels = F.transform("telegram_channels", lambda c: F.struct(
        c["chat_id"].alias("chat_id"), c["channel_name"].alias("bot_token")))
    stamp = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
    payload = encode_result(F.col("check_name"), F.col("output"), status.code_to_status(F.col("exit_code")), stamp,
                            channels, F.col("mute_notifications"), F.col("mute_notifications_until"))
    return (out.filter(F.col("error").isNull()).select("msg_id", payload.alias("payload")),
            out.filter(F.col("error").isNotNull()).select("msg_id", "check_name", "error", F.col("output").alias("message")))


def run_batch(batch: DataFrame, batch_id: int, base: str, inputs: DataFrame, secrets: DataFrame,
              find: Callable[[str], Function | None], as_of: str | None = None) -> None:
    """Runs one micro-batch of task messages (msg_id, payload)."""
    good, rejects = decode_tasks(batch)
    good = good.persist()
    # Functions run once, for the messages and the failures alike.
    done = run_tasks(good, inputs, secrets, find).persist()
    try:
        messages, failures = outcomes(done, as_of)
        publish_batch(messages, f"{base}/results", batch_id)
        write_folder(failures, f"{base}/failures/batch_id={batch_id}")
        write_folder(rejects.select("msg_id", "payload", "reason"), f"{base}/rejects/batch_id={batch_id}")
    finally:
        done.unpersist()
        good.unpersist()


def start_runner(spark: SparkSession, source: str, base: str, checkpoint: str, inputs: DataFrame, secrets: DataFrame,
                 find: Callable[[str], Function | None], as_of: str | None = None,
                 max_files_per_trigger: int | None = None, available_now: bool = True):
    """Starts the worker on a task sink; results appear under ``base``/results."""
    stream = read_payloads(spark, source, stream=True, max_files_per_trigger=max_files_per_trigger)
    writer = (stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(each_batch(lambda df, n: run_batch(df, n, base, inputs, secrets, find, as_of))))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()
