"""Result and metric tables: creation, idempotent appends, time chunks,
retention and compaction (K2, K3, K7, K8, K9, K10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas

def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def create_tables(spark: SparkSession, base: str, database: str = "default") -> dict[str, str]:
    """K7: create both tables in ``database`` if absent: parquet in the layout
    that :func:`write_batch` writes, so what is stored is what the catalog reads."""
    paths = {"check_result": f"{base}/check_result",
             "check_result_perf_data": f"{base}/check_result_perf_data"}
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, schema in (("check_result", schemas.CHECK_RESULT),
                         ("check_result_perf_data", schemas.CHECK_RESULT_PERF)):
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        folder = spark._jvm.org.apache.hadoop.fs.Path(paths[name])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.{name} (batch_id INT, {ddl}) USING parquet "
                  f"PARTITIONED BY (batch_id, event_date) LOCATION '{paths[name]}'")
    return paths


def refresh_tables(spark: SparkSession, database: str = "default") -> None:
    """Register the folders written since as partitions of the catalog's tables."""
    for name in ("check_result", "check_result_perf_data"):
        spark.sql(f"ALTER TABLE `{database}`.{name} RECOVER PARTITIONS")


def write_folder(df: DataFrame, path: str) -> None:
    """Replace a folder as a whole, whatever partitions it held before (the
    session may be set to replace single partitions only)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """K2/K3: append one micro-batch idempotently.

    Each batch owns the folder ``batch_id=<n>``; a retried batch replaces its
    own folder as a whole, also when its rows fall on other dates, so replays
    never duplicate rows. Rows are dealt by date first: a batch leaves a file per date,
    several for a date too large for one task, and not one per date and task.
    """
    (df.hint("rebalance", "event_date").write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("event_date").parquet(f"{path}/batch_id={batch_id}"))


def with_chunk(df: DataFrame, ts: str = "timestamp",
               chunk_seconds: int = schemas.CHUNK_SECONDS) -> DataFrame:
    """K8: chunk id = floor(epoch seconds / chunk length) (7 days)."""
    secs = F.timestamp_diff("SECOND", _epoch(), F.col(ts))
    return df.withColumn("chunk_id", F.floor(secs / chunk_seconds).cast("bigint"))


def retention_rows(df: DataFrame, as_of: str, ts: str = "timestamp",
                   keep_seconds: int = schemas.RETENTION_SECONDS) -> DataFrame:
    """K9 (row form): rows younger than the retention window."""
    cutoff = F.timestamp_add("SECOND", F.lit(-keep_seconds), F.lit(as_of).cast("timestamp_ntz"))
    return df.filter(F.col(ts) >= cutoff)


def retention_chunks(df: DataFrame, as_of: str, ts: str = "timestamp",
                     chunk_seconds: int = schemas.CHUNK_SECONDS,
                     keep_seconds: int = schemas.RETENTION_SECONDS) -> DataFrame:
    """K9 (chunk form): a chunk is dropped once its end is at or before
    as_of - retention. One row per chunk: bounds, row count, dropped flag."""
    cutoff = F.timestamp_add("SECOND", F.lit(-keep_seconds), F.lit(as_of).cast("timestamp_ntz"))
    chunks = with_chunk(df, ts, chunk_seconds).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"))
    start = F.timestamp_add("SECOND", F.col("chunk_id") * chunk_seconds, _epoch())
    end = F.timestamp_add("SECOND", (F.col("chunk_id") + 1) * chunk_seconds, _epoch())
    return chunks.select("chunk_id", start.alias("chunk_start"), end.alias("chunk_end"), "n_rows",
                         (end <= cutoff).alias("dropped"))


def expired_dates(path: str, spark: SparkSession, as_of: str,
                  keep_seconds: int = schemas.RETENTION_SECONDS) -> list[tuple[int, object]]:
    """K9: the stored (batch_id, event_date) partitions that are wholly older
    than the retention window. Only partition values are read; dates before the
    window are few, one per day and batch."""
    rows = spark.read.parquet(path).select("batch_id", "event_date").distinct()
    cutoff = F.timestamp_add("SECOND", F.lit(-keep_seconds), F.lit(as_of).cast("timestamp_ntz"))
    end = F.date_add("event_date", 1).cast("timestamp_ntz")
    return [(r[0], r[1]) for r in rows.filter(end <= cutoff).collect()]


def drop_expired(path: str, spark: SparkSession, as_of: str,
                 keep_seconds: int = schemas.RETENTION_SECONDS) -> int:
    """K9 on a stored table: remove the partitions whose day ended before the
    retention window, by Hadoop's file system (any store Spark can read).
    Returns how many went; running it again removes nothing more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = expired_dates(path, spark, as_of, keep_seconds)
    for batch_id, day in gone:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}/event_date={day}")
        folder.getFileSystem(conf).delete(folder, True)
    return len(gone)


ROWS_PER_FILE = 5_000_000


def compact(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Sorted, zstd-compressed layout: rows clustered by (event_date,
    check_name, timestamp desc) so per-check reads skip row groups.

    Names carry a Bloom filter where there are too many of them for a dictionary, so a
    point read passes over row groups whose range holds the name but whose rows do not.
    Rebalancing by (event_date, check_name) groups a check's rows of a day and
    lets Spark split what is too large and merge what is small, so the number of
    files follows the data; a day's file is cut at ``rows_per_file``.
    """
    (df.hint("rebalance", "event_date", "check_name")
     .sortWithinPartitions("event_date", "check_name", F.col("timestamp").desc())
     .write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
     .option("parquet.bloom.filter.enabled#check_name", "true")
     .option("maxRecordsPerFile", rows_per_file).partitionBy("event_date").parquet(path))
