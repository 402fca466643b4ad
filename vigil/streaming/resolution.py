"""Resolved checks kept up by changes (D5, D9-D11): a changed check, script, channel
or secret leads to the checks that depend on it, these are resolved again, and the
stored table takes their new form. The rest is neither read from the table nor
resolved.

The table is one of :mod:`vigil.sinks.merged`: a batch adds a row per impacted check,
the newest batch's row is the check's present form, and a check that went or cannot be
resolved any more leaves a row that says so. Secret values are not stored, only the
names of their keys; whoever runs a check fetches them then (L2).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import registry as REG
from vigil.session import each_batch
from vigil.sinks.merged import add_rows, fold, read_merged
from vigil.sinks.stored import Manifest, last_done, mark_done

CHANGE = "kind string, name string"
RESOLVED = ("check_name string, version int, resolvable boolean, passive boolean, check_interval bigint, "
            "script_ref string, script struct<content:string,python_requirements:array<string>>, "
            "secret_refs array<string>, secret_keys array<string>, "
            "channels array<struct<chat_id:string,channel_name:string>>, mute boolean, mute_until timestamp_ntz")
_FIELDS = ("check_name", "version", "resolvable", "passive", "check_interval", "script_ref", "script", "secret_refs",
           "secret_keys", "channels", "mute", "mute_until")


class Definitions(NamedTuple):
    """Declared records as they are now: valid checks, scripts and channels, and
    secrets (secret_name, key, value)."""
    checks: DataFrame
    scripts: DataFrame
    channels: DataFrame
    secrets: DataFrame


def newest(rows: DataFrame) -> DataFrame:
    """One row per check, that of the largest ``version``."""
    return (rows.groupBy("check_name").agg(F.max_by(F.struct(*_FIELDS), "version").alias("r")).select("r.*"))


def dependents(changes: DataFrame, now: Definitions) -> DataFrame:
    """Distinct names of the checks that ``changes`` (:data:`CHANGE`) touch, by name or
    by what they refer to. A secret counts through a check's secret refs and through
    the bot token of a channel, as either decides whether the check can be resolved."""
    def names(kind: str) -> DataFrame:
        return changes.filter(F.col("kind") == kind).select("name")

    by_token = (now.channels.join(names("secret").withColumnRenamed("name", "bot_token_ref").distinct(),
                                  "bot_token_ref", "left_semi").select(F.col("channel_name").alias("name")))
    changed = {"script": names("script"), "secret": names("secret"), "channel": names("channel").unionByName(by_token)}
    out = names("check").withColumnRenamed("name", "check_name")
    for kind, what in changed.items():
        out = out.unionByName(REG.impacted(now.checks, what, kind).select("check_name"))
    return out.filter(F.col("check_name").isNotNull()).distinct()


def resolve_batch(changes: DataFrame, batch_id: int, base: str, definitions: Callable[[], Definitions]) -> None:
    """Resolves again what a batch of changes touches (idempotent per batch). The
    definitions are read when the batch runs, so they hold its changes at least; a
    replay may see newer ones, whose own changes then follow."""
    now = definitions()
    changes = changes.persist()
    touched = dependents(changes, now).persist()
    try:
        part = now.checks.join(touched, "check_name", "left_semi")
        good = REG.resolved_checks(part, now.scripts, REG.resolve_bot_tokens(now.channels, now.secrets), now.secrets)
        keys = F.when(F.col("secrets").isNotNull(), F.array_sort(F.map_keys("secrets")))
        good = good.withColumn("secret_keys", keys).drop("secrets").withColumn("resolvable", F.lit(True))
        # A check without a resolved form keeps its name and the number of the batch.
        rows = (touched.join(good, "check_name", "left")
                .withColumn("resolvable", F.coalesce("resolvable", F.lit(False)))
                .withColumn("version", F.lit(batch_id)))
        add_rows(rows.select(*_FIELDS), f"{base}/resolved", batch_id, newest)
    finally:
        touched.unpersist()
        changes.unpersist()
    mark_done(changes.sparkSession, base, batch_id)


def resolved_now(spark: SparkSession, base: str) -> DataFrame:
    """The checks that can run, as the last batch left them."""
    return read_merged(spark, f"{base}/resolved", RESOLVED, newest).filter("resolvable").drop("resolvable", "version")


def fold_resolved(spark: SparkSession, base: str) -> Manifest:
    """Merges the batches so far into one row per check."""
    return fold(spark, f"{base}/resolved", RESOLVED, newest, last_done(spark, base))


def start_resolution(spark: SparkSession, source: str, base: str, checkpoint: str,
                     definitions: Callable[[], Definitions], max_files_per_trigger: int | None = None):
    """Follows change notices (JSON lines of :data:`CHANGE`) and keeps ``base``/resolved."""
    reader = spark.readStream.schema(CHANGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (reader.json(source).writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(each_batch(lambda df, n: resolve_batch(df, n, base, definitions)))
            .trigger(availableNow=True).start())
