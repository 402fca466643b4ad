"""D12 in a stream: every result with the version of its check's state that held at
its time, while results and versions arrive on two feeds, neither of them in order.

A result is answered when the feed of versions has come a ``window`` past its time:
versions that are late by less than the window are there by then. Between batches
two bounded states are kept in alternating slots, as batch n reads those of batch
n-1 and a replay finds them intact: the results that wait, and of the versions those
after the mark (the newest version's time less the window) and the last one per
check before it. Versions are stored as well, and a result that comes after the mark
has passed it is answered from the stored versions, so nothing is dropped. A version
that is late by more than the window still holds for results answered from then on;
it is reported under ``late_versions``, as earlier answers stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.alerts import asof_join
from vigil.session import each_batch
from vigil.sinks.stored import last_done, mark_done, read_stored
from vigil.sinks.tables import write_folder

RESULT = "event_id bigint, check_name string, ts timestamp_ntz, status_name string"
VERSION = "check_name string, version_seq bigint, valid_from timestamp_ntz, mute boolean, mute_until timestamp_ntz"
_RESULT = ("event_id", "check_name", "ts", "status_name")
_VERSION = ("check_name", "version_seq", "valid_from", "mute", "mute_until")
_STATE = ["version_seq", "mute", "mute_until"]


def _micros(c: str) -> Column:
    """Microseconds since 1970 of a UTC wall-clock time; as a number, any year passes."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def _answered(results: DataFrame, versions: DataFrame) -> DataFrame:
    return asof_join(results, versions, "check_name", "ts", "valid_from", "version_seq", _STATE)


def _slots(spark: SparkSession, base: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """(waiting results, kept versions) after a batch."""
    at = batch_id % 2
    return (spark.read.schema(RESULT).parquet(f"{base}/waiting/slot={at}").select(*_RESULT),
            spark.read.schema(VERSION).parquet(f"{base}/kept/slot={at}").select(*_VERSION))


def asof_batch(batch: DataFrame, batch_id: int, base: str, window_seconds: int) -> None:
    """Answers what one micro-batch of both feeds lets answer (idempotent per batch).
    A result without a time is answered at once, with no version."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        results = new_results = batch.filter(F.col("_kind") == "result").select(*_RESULT)
        new_versions = batch.filter((F.col("_kind") == "version") & F.col("valid_from").isNotNull()).select(*_VERSION)
        versions = new_versions
        before = None
        if batch_id > 0:
            before = spark.read.schema("mark bigint").parquet(f"{base}/mark/slot={(batch_id - 1) % 2}").first()["mark"]
            waiting, kept = _slots(spark, base, batch_id - 1)
            results, versions = results.unionByName(waiting), versions.unionByName(kept)
        newest = new_versions.agg(F.max(_micros("valid_from"))).first()[0]
        marks = [m for m in (before, None if newest is None else newest - window_seconds * 1_000_000) if m is not None]
        mark = max(marks, default=None)

        def upto(c: str, m: int | None) -> Column:
            return F.lit(False) if m is None else _micros(c) <= F.lit(m)

        write_folder(new_versions, f"{base}/versions/batch_id={batch_id}")
        write_folder(new_versions.filter(upto("valid_from", before)), f"{base}/late_versions/batch_id={batch_id}")
        late = F.coalesce(upto("ts", before), F.lit(False))           # waiting results are all after the mark before
        settled = F.coalesce(upto("ts", mark), F.lit(True))
        on_time = _answered(results.filter(settled & ~late), versions)
        late_rows = new_results.filter(late)
        stored = (read_stored(spark, f"{base}/versions", VERSION, before=batch_id + 1).select(*_VERSION)
                  .join(late_rows.select("check_name").distinct(), "check_name", "left_semi"))
        write_folder(on_time.unionByName(_answered(late_rows, stored)), f"{base}/answers/batch_id={batch_id}")

        slot = batch_id % 2
        write_folder(results.filter(~settled), f"{base}/waiting/slot={slot}")
        last = (versions.filter(upto("valid_from", mark)).groupBy("check_name")
                .agg(F.max(F.struct("valid_from", "version_seq", "mute", "mute_until")).alias("v"))
                .select("check_name", "v.version_seq", "v.valid_from", "v.mute", "v.mute_until"))
        write_folder(versions.filter(~upto("valid_from", mark)).unionByName(last), f"{base}/kept/slot={slot}")
        write_folder(spark.range(1).select(F.lit(mark).cast("bigint").alias("mark")), f"{base}/mark/slot={slot}")
        mark_done(spark, base, batch_id)
    finally:
        batch.unpersist()


def start_asof(results: DataFrame, versions: DataFrame, base: str, checkpoint: str, window_seconds: int):
    """Starts the join of two streams, results (:data:`RESULT`) and versions
    (:data:`VERSION`); answers appear under ``base``/answers."""
    both = (results.select(*_RESULT, F.lit("result").alias("_kind"))
            .unionByName(versions.select(*_VERSION, F.lit("version").alias("_kind")), allowMissingColumns=True))
    return (both.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(each_batch(lambda df, n: asof_batch(df, n, base, window_seconds)))
            .trigger(availableNow=True).start())


def asof_so_far(spark: SparkSession, base: str, waiting: bool = True) -> DataFrame:
    """The answers, and with ``waiting`` also those that the results still waiting
    would get from the versions known so far."""
    answers = spark.read.parquet(f"{base}/answers").select(*_RESULT, *_STATE)
    if not waiting:
        return answers
    return answers.unionByName(_answered(*_slots(spark, base, last_done(spark, base))))
