"""Present state kept while messages arrive: the latest result of every check (G2,
D7) and its mute state (A7, H2-H4). Both are tables of :mod:`vigil.sinks.merged`, so
a batch costs its own rows, a read costs a row per check and folding is apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import perf
from vigil.operators import mute as M
from vigil.operators import results as R
from vigil.operators.decode import tag_results
from vigil.session import each_batch
from vigil.sinks.merged import add_rows, read_merged
from vigil.sinks.stored import mark_done
from vigil.sinks.tables import write_folder
from vigil.sources.tables import read_mute_commands, read_payloads

LATEST = "check_name string, timestamp timestamp_ntz, status smallint, output string"


def latest_batch(batch: DataFrame, batch_id: int, base: str, as_of: str | None = None) -> None:
    """Adds the newest result of every check that a batch of messages brings.
    Older results that come late stay behind what is there; undecodable ones are for
    the ingest to report."""
    good = tag_results(batch, as_of=as_of).filter(F.col("_reason").isNull())
    rows = good.select("check_name", "timestamp", F.col("status_code").cast("smallint").alias("status"),
                       perf.display_text(F.col("output")).alias("output")).persist()
    try:
        add_rows(rows, f"{base}/latest", batch_id, R.latest_all)
    finally:
        rows.unpersist()
    mark_done(batch.sparkSession, base, batch_id)


def latest_results(spark: SparkSession, base: str) -> DataFrame:
    """The latest result of every check, without the history."""
    return read_merged(spark, f"{base}/latest", LATEST, R.latest_all)


def start_latest(spark: SparkSession, source: str, base: str, checkpoint: str, as_of: str | None = None,
                 max_files_per_trigger: int | None = None):
    """Follows the result stream and keeps ``base``/latest."""
    return (read_payloads(spark, source, stream=True, max_files_per_trigger=max_files_per_trigger)
            .writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(each_batch(lambda df, n: latest_batch(df, n, base, as_of)))
            .trigger(availableNow=True).start())


def mute_batch(batch: DataFrame, batch_id: int, base: str, registry: Callable[[], DataFrame]) -> None:
    """Adds what a batch of commands does to the mute state. Commands may
    arrive in any order: what counts is their number. Those on checks that the
    registry does not know when the batch runs, or with an ``until`` that cannot be
    read, go to ``base``/rejects and change nothing."""
    # One look at the registry, one reading of the batch.
    tagged = M.tagged_commands(registry(), batch).persist()
    try:
        accepted, rejects = M.split_tagged(tagged)
        add_rows(M.effects(accepted), f"{base}/mutes", batch_id, M.merge_effects)
        write_folder(rejects, f"{base}/rejects/batch_id={batch_id}")
    finally:
        tagged.unpersist()
    mark_done(batch.sparkSession, base, batch_id)


def muted_now(spark: SparkSession, base: str, registry: DataFrame) -> DataFrame:
    """Mute state of every check of ``registry`` after the commands so far."""
    return M.applied(registry, read_merged(spark, f"{base}/mutes", M.EFFECT, M.merge_effects))


def start_mutes(spark: SparkSession, source: str, base: str, checkpoint: str, registry: Callable[[], DataFrame],
                max_files_per_trigger: int | None = None):
    """Follows mute and unmute commands and keeps ``base``/mutes and ``base``/rejects."""
    return (read_mute_commands(spark, source, stream=True, max_files_per_trigger=max_files_per_trigger)
            .writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(each_batch(lambda df, n: mute_batch(df, n, base, registry)))
            .trigger(availableNow=True).start())
