"""Stored results and metrics; latest status and metric history (C1-C7,
E1-E3, F1, F2, G1-G3, D7, K2, K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import perf, status
from vigil.schemas import PENDING_TEXT


def stored_results(results: DataFrame, ts: str = "ts", code: str = "status_code",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the result table: timestamp, check_name, status, output, event_date.

    ``output`` is the display text only; the status code is normalised.
    """
    return results.select(*keep,
        F.col(ts).alias("timestamp"), "check_name",
        status.normalize_code(F.col(code)).alias("status"),
        perf.display_text(F.col("output")).alias("output"),
        F.to_date(F.col(ts)).alias("event_date"))


def perf_rows(results: DataFrame, ts: str = "ts", keep_first: bool = True) -> DataFrame:
    """Long-form metric rows (row-local explode, no shuffle): timestamp,
    check_name, pos, perf_key, perf_value, parse_ok, event_date.

    Tokens are cut and trimmed once per row and exploded as structs, so an
    exploded row carries its own token only. With ``keep_first`` a later repeat
    of a key within one output is dropped (S6).
    """
    texts = perf.metric_texts(F.col("output"))
    rows = results.select(F.col(ts).alias("timestamp"), "check_name",
                          F.inline(perf.first_texts(texts) if keep_first else texts))
    parsed = rows.select("timestamp", "check_name", "pos", "perf_key", perf.parse_f32(F.col("text")).alias("_pf"))
    return parsed.select("timestamp", "check_name", "pos", "perf_key",
                         F.coalesce(F.col("_pf"), F.lit(0.0).cast("float")).alias("perf_value"),
                         F.col("_pf").isNotNull().alias("parse_ok"),
                         F.to_date("timestamp").alias("event_date"))


def parse_warnings(metrics: DataFrame) -> DataFrame:
    """Per check: metric values that were unparseable and set to 0.0."""
    return (metrics.groupBy("check_name")
            .agg(F.count_if(~F.col("parse_ok")).alias("n_warnings"),
                 F.count(F.lit(1)).alias("n_metrics")))


def latest_one(stored: DataFrame, check_name: str) -> DataFrame:
    """Latest result of one check (F1 + G1): point filter, then top-1."""
    return (stored.filter(F.col("check_name") == check_name)
            .orderBy(F.col("timestamp").desc()).limit(1)
            .select("check_name", "timestamp", "status", "output"))


def latest_all(stored: DataFrame) -> DataFrame:
    """Latest result of every check.

    The newest time per check is a hash aggregate over fixed-width values (a
    row per check and task in the exchange); only the rows at that time are
    joined back and reduced, ties by status and output. No task sorts its input
    and no output text travels but the winners'.
    """
    newest = stored.groupBy("check_name").agg(F.max("timestamp").alias("timestamp"))
    return (stored.select("check_name", "timestamp", "status", "output")
            .join(newest, ["check_name", "timestamp"], "left_semi")
            .groupBy("check_name").agg(F.max(F.struct("timestamp", "status", "output")).alias("l"))
            .select("check_name", "l.timestamp", "l.status", "l.output"))


def status_all(registry: DataFrame, latest: DataFrame) -> DataFrame:
    """Status of every registered check (D7, C7); no result -> Pending."""
    found = latest.select("check_name", F.col("timestamp").alias("ts"),
                          F.col("status").alias("code"), F.col("output").alias("out"))
    j = registry.select("check_name", "passive", "mute", "mute_until").join(
        found, "check_name", "left")
    has = F.col("code").isNotNull()
    return j.select(
        "check_name", "passive",
        F.when(has, F.col("out")).otherwise(F.lit(PENDING_TEXT)).alias("output"),
        F.when(has, status.code_to_status(F.col("code"))).otherwise(F.lit("Pending")).alias("status"),
        F.col("ts").alias("timestamp"),
        F.col("mute").alias("notifications_muted"),
        F.col("mute_until").alias("notifications_muted_until"))


def perf_history(metrics: DataFrame, check_name: str | None = None) -> DataFrame:
    """Metric history (E1): per (check, timestamp) a key-ordered map.

    Rows are dealt by (check, timestamp), so one busy check is spread over many
    tasks. Repeats of a (check, timestamp, key), as redelivery leaves them, are
    reduced to the first position by a hash aggregate before the map is built;
    both steps share the one exchange.
    """
    if check_name is not None:
        metrics = metrics.filter(F.col("check_name") == check_name)
    one = (metrics.repartition("check_name", "timestamp")
           .groupBy("check_name", "timestamp", "perf_key")
           .agg(F.min_by("perf_value", "pos").alias("perf_value")))
    return (one.groupBy("check_name", "timestamp")
            .agg(F.map_from_entries(F.sort_array(F.collect_list(
                F.struct(F.col("perf_key").alias("k"), F.col("perf_value").alias("v"))))).alias("perf_data")))


def sorted_history(history: DataFrame) -> DataFrame:
    """A metric history in ascending time, checks in name order."""
    return history.orderBy("check_name", "timestamp")


def perf_history_row_local(results: DataFrame, ts: str = "ts") -> DataFrame:
    """The same map straight from raw results, one result per row — no
    shuffle at all. Results without metrics produce no row."""
    texts = results.select("check_name", F.col(ts).alias("timestamp"),
                           perf.first_texts(perf.metric_texts(F.col("output"))).alias("_t"))
    pairs = F.transform("_t", lambda x: F.struct(
        x["perf_key"].alias("k"), F.coalesce(perf.parse_f32(x["text"]), F.lit(0.0).cast("float")).alias("v")))
    return (texts.filter(F.size("_t") > 0)
            .select("check_name", "timestamp", F.map_from_entries(pairs).alias("perf_data")))


def history_columns(history: DataFrame, keys: list[str]) -> DataFrame:
    """Flat projection of a metric-history map for comparison and export."""
    pd = F.col("perf_data")
    cols = [F.col("check_name"), F.col("timestamp"),
            F.size(pd).cast("bigint").alias("n_metrics"),
            F.array_join(F.map_keys(pd), ",").alias("perf_keys")]
    cols += [pd[k].cast("double").alias(f"metric_{k}") for k in keys]
    return history.select(*cols)


def check_list(registry: DataFrame) -> DataFrame:
    """Name, passive, interval of every registered check."""
    return registry.select("check_name", "passive", F.col("check_interval").alias("interval"))


def check_count(registry: DataFrame) -> DataFrame:
    """Number of loaded checks."""
    return registry.agg(F.count(F.lit(1)).alias("n_checks"))


def membership(df: DataFrame, registry: DataFrame, key: str = "check_name"):
    """split rows into (accepted, rejected) by registry membership. No hint:
    Spark broadcasts the names when they measure small and shuffles otherwise
    (AQE splits a skewed check's partition)."""
    names = registry.select(F.col("check_name").alias(key))
    return df.join(names, key, "left_semi"), df.join(names, key, "left_anti")
