"""Tables of one row per key that streams keep by adding to them.

A table has a ``merge``: it turns rows into one row per key, and does not mind in
which order or grouping rows come, nor whether they are merged rows already. Every
micro-batch merges its own rows and adds the result, a row per key that it
touched, as its folder ``batch_id=<n>``; nothing that is stored is read or
rewritten for it. Readers merge what is there. Now and then :func:`fold` merges the
finished batches into one folder, committed by the manifest of
:mod:`vigil.sinks.stored`, so a reader merges one row per key and those of the few
batches since. A replayed batch replaces its folder; one that has been folded
already writes a folder that nobody reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.sinks.stored import Manifest, compact_stored, read_stored
from vigil.sinks.tables import write_folder

Merge = Callable[[DataFrame], DataFrame]


def add_rows(rows: DataFrame, path: str, batch_id: int, merge: Merge) -> None:
    """Adds a batch's rows, merged, to the table; repeating a batch changes nothing."""
    write_folder(merge(rows), f"{path}/batch_id={batch_id}")


def read_merged(spark: SparkSession, path: str, schema: StructType | str, merge: Merge) -> DataFrame:
    """The table, one row per key."""
    return merge(read_stored(spark, path, schema).drop("batch_id", "event_date"))


def fold(spark: SparkSession, path: str, schema: StructType | str, merge: Merge, upto: int) -> Manifest:
    """Merges the batches up to ``upto`` and what was folded before into one folder;
    see :func:`vigil.sinks.stored.vacuum` for the folders that it replaces."""
    def write(rows: DataFrame, folder: str) -> None:
        merged = merge(rows.drop("batch_id", "event_date"))
        write_folder(merged.withColumn("batch_id", F.lit(upto)), folder)

    return compact_stored(spark, path, schema, upto, whole=True, write=write)
