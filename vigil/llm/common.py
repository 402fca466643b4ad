"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import scratch_path

# Bytes of text that a Python task holds as numpy arrays at once.
CHUNK_BYTES = 2_000_000


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors and gives later joins exact file sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if _SCOPES:
        _SCOPES[-1].paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


_SCOPES: list[Scratch] = []


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table as :func:`materialise` returned it."""
    return hasattr(df, "_scratch")


class Scratch:
    """The tables written while a block ran; see :func:`scratch`."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Leaves the table that ``materialise`` returned as ``df``."""
        self.kept.append(df._scratch)
        return df


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Inner tables of an operator: those that :func:`materialise` writes inside
    the block are deleted when it ends, but for those kept. What the block returns
    must therefore be written, and kept, inside it. Tables kept by an inner block
    belong to the block around it."""
    scope = Scratch()
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)
        if _SCOPES:
            _SCOPES[-1].paths += scope.kept
        for path in set(scope.paths) - set(scope.kept):
            drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it has no more
    than ``rows`` rows (counted from the files' footers); else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def held_out(doc_id: Column) -> Column:
    """Documents never learnt from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """Deterministic value in [0, 1) of a row, for bounded training samples."""
    return F.pmod(F.xxhash64(F.lit(7919), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names starting with ``wanted`` that no column of ``df`` bears (whatever
    the letters' case), so that callers' extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list]]:
    """(first row, values) of successive runs of rows holding about ``size``
    bytes; a single longer text makes a run of its own."""
    buf, start, held = [], 0, 0
    for k, v in enumerate(texts):
        s = v.as_py()
        buf.append(s)
        held += len(s) if s else 1
        if held >= size:
            yield start, buf
            buf, start, held = [], k + 1, 0
    if buf:
        yield start, buf


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: int = 0):
    """While eager jobs with wide rows run: no more rows in an Arrow batch than
    this (and no more bytes than ``size``, if given, but for a longer row), as a
    batch is held by Spark and by the worker, several times over."""
    was = int(spark.conf.get(BATCH_CONF))
    was_bytes = spark.conf.get(BYTES_CONF, None)
    spark.conf.set(BATCH_CONF, min(was, rows) if was > 0 else rows)
    if size:
        spark.conf.set(BYTES_CONF, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, was)
        if size and was_bytes is None:
            spark.conf.unset(BYTES_CONF)
        elif size:
            spark.conf.set(BYTES_CONF, was_bytes)


#: What frees the caches that an operator keeps in a Python worker between tasks.
CACHES: dict[str, Callable[[], None]] = {}


@contextlib.contextmanager
def task(owner: str):
    """Around an operator's Python code in a worker. Spark hands workers from
    one stage to the next and keeps idle ones, so the caches of other operators
    go first, and what the allocators have spare goes back when the task ends."""
    for name, free in CACHES.items():
        if name != owner:
            free()
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)


def in_task(owner: str):
    """The same for a function from batches to batches."""
    def wrap(fn):
        @functools.wraps(fn)
        def run(batches):
            with task(owner):
                yield from fn(batches)
        return run
    return wrap
