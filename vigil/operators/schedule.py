"""Fixed-rate schedules as data.

A check with interval I registered at L runs at L+I, L+2I, ... (anchored to
the planned time, so there is no drift and missed slots still fire). A changed
registry is planned anew from its folded state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.sinks.stored import publish_batch


def schedulable(checks: DataFrame) -> DataFrame:
    """active checks with a positive interval."""
    return checks.filter(~F.coalesce(F.col("passive"), F.lit(False))
                         & F.col("check_interval").isNotNull() & (F.col("check_interval") > 0))


RUNS_PER_BUCKET = 4096


def plan(checks: DataFrame, load_at: str, until: str) -> DataFrame:
    """Run times in (load_at, until] for every schedulable check.

    Row-local generation, no shuffle: buckets of runs are exploded first and
    the runs of a bucket then, so no row holds all runs of a check. The range
    is empty, not an error, when the first run is past ``until``. The check's
    columns are kept, so a plan built from resolved checks can be turned into
    task messages without joining back.
    """
    load = F.lit(load_at).cast("timestamp_ntz")
    span = F.timestamp_diff("SECOND", load, F.lit(until).cast("timestamp_ntz"))
    iv, size = F.col("check_interval"), F.lit(RUNS_PER_BUCKET).cast("bigint")
    n = F.floor(span / iv).cast("bigint")
    none = F.array().cast("array<bigint>")
    buckets = F.when(n >= 1, F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / size).cast("bigint")))
    start = F.col("_bucket") * size
    return (schedulable(checks)
            .select("*", n.alias("_n"), F.explode(F.coalesce(buckets, none)).alias("_bucket"))
            .select("*", F.explode(F.sequence(start + 1, F.least(F.col("_n"), start + size))).alias("run_index"))
            .drop("_n", "_bucket")
            .withColumn("run_at", F.timestamp_add("SECOND", F.col("run_index") * iv, load)))


def due(planned: DataFrame, as_of: str) -> DataFrame:
    """Runs due at ``as_of``."""
    return planned.filter(F.col("run_at") <= F.lit(as_of).cast("timestamp_ntz"))


def next_due(planned: DataFrame, n: int) -> DataFrame:
    """The ``n`` earliest runs (top-k; ties by check name)."""
    return planned.orderBy("run_at", "check_name").limit(n)


def task_payloads(due_runs: DataFrame) -> DataFrame:
    """One JSON task (the resolved check) per due run.

    ``due_runs`` is a plan of resolved checks (their columns kept), so the
    payload is built row-locally. Secrets and bot tokens never travel: a task
    names its secrets, and whoever runs it resolves them (L2).
    """
    task = F.struct(
        F.col("passive"),
        F.col("script"),
        F.col("check_interval").alias("interval"),
        F.col("check_name"),
        F.col("secret_refs"),
        F.col("channels").alias("telegram_channels"),
        F.col("mute").alias("mute_notifications"),
        F.date_format("mute_until", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("mute_notifications_until"))
    return due_runs.select("check_name", "run_at", F.to_json(task).alias("payload"))


def publish(messages: DataFrame, path: str, batch: int | str = 0) -> bool:
    """J4/K4 sink: messages (msg_id, payload) as JSON lines, the layout that the
    stream readers take; publishing a batch again adds nothing."""
    return publish_batch(messages, path, batch)
