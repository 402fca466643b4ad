"""Readers of the given parquet tables and of check-system record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil import schemas

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _reader(spark: SparkSession, stream: bool, max_files_per_trigger: int | None):
    if not stream:
        return spark.read
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader


def read_payloads(spark: SparkSession, path: str, stream: bool = False,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw stream records (msg_id, payload) written as JSON lines (A4, A5)."""
    return _reader(spark, stream, max_files_per_trigger).schema("msg_id BIGINT, payload STRING").json(path)


def read_change_feed(spark: SparkSession, path: str, stream: bool = False,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Registry change events (A2) with a fixed schema (no inference)."""
    return _reader(spark, stream, max_files_per_trigger).schema(schemas.REGISTRY_CHANGE).json(path)


def read_submissions(spark: SparkSession, path: str, stream: bool = False,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Submitted results."""
    return _reader(spark, stream, max_files_per_trigger).schema(schemas.SUBMISSION).json(path)


def read_mute_commands(spark: SparkSession, path: str, stream: bool = False,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Mute and unmute commands."""
    return _reader(spark, stream, max_files_per_trigger).schema(schemas.MUTE_COMMAND).json(path)


def read_check_specs(spark: SparkSession, path: str) -> DataFrame:
    """Full scan of check definitions (A1)."""
    return spark.read.schema(schemas.CHECK_SPEC).json(path)
