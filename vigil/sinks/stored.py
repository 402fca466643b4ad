"""Stored tables that are compacted while they are written and read.

A micro-batch owns the folder ``<table>/batch_id=<n>``; nothing else is needed for
it to be part of the table. Compaction rewrites the batches that are done into one
sorted folder under ``<table>.compacted`` and then commits a new version of the
manifest: the last batch that compacted folders cover, and these folders. The
commit is the creation of one file under ``<table>.manifest`` that fails if the
version is there already, so of two compactions one wins, and readers see the
table before or after, never between.

Readers (:func:`read_stored`) take the manifest's folders and the batches after
them. Rows keep their ``batch_id`` through compaction, so a replayed old batch sees
exactly the earlier batches, as when it ran first; its own folder is already
covered and stays unread. Folders that no version needs go with :func:`vacuum`.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructType

from vigil.schemas import CHUNK_SECONDS, RETENTION_SECONDS
from vigil.sinks.tables import compact

DAY = 24 * 3600


@dataclass(frozen=True)
class Manifest:
    """Version, last batch covered by the compacted folders, and these folders."""
    version: int = 0
    upto: int = -1
    folders: tuple[str, ...] = ()


class CommitConflict(RuntimeError):
    """Another compaction committed first; this one's folder is not part of the table."""


class _Store:
    """Hadoop's file system of a path: any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def create(self, path: str, text: str) -> None:
        """A new file, complete when it appears: written aside, then renamed, which
        fails where the name is taken."""
        aside = self.path(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(self.path(path)) or not self._fs.rename(aside, self.path(path)):
            self._fs.delete(aside, False)
            raise CommitConflict(path)

    def read(self, path: str) -> str:
        stream = self._fs.open(self.path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.path(path))

    def move(self, folder: str, to: str) -> bool:
        """Renames a folder; false where the name is taken."""
        target = self.path(to)
        self._fs.mkdirs(target.getParent())
        return not self._fs.exists(target) and self._fs.rename(self.path(folder), target)

    def delete(self, path: str) -> None:
        self._fs.delete(self.path(path), True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name."""
    return _Store(spark, path).exists(path)


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The table's newest version; without one, nothing is compacted yet."""
    store, folder = _Store(spark, path), f"{path}.manifest"
    versions = sorted(int(n) for n in store.names(folder) if n.isdigit())
    if not versions:
        return Manifest()
    found = json.loads(store.read(f"{folder}/{versions[-1]:020d}"))
    return Manifest(versions[-1], found["upto"], tuple(found["folders"]))


def mark_done(spark: SparkSession, base: str, batch_id: int) -> None:
    """Records that all outputs of a batch are written; only such batches are
    compacted. A replay finds the record there."""
    try:
        _Store(spark, base).create(f"{base}/_done/{batch_id}", "")
    except CommitConflict:
        pass


def last_done(spark: SparkSession, base: str) -> int:
    """The last batch recorded as done, or -1; batches end in order."""
    return max((int(n) for n in _Store(spark, base).names(f"{base}/_done") if n.isdigit()), default=-1)


def publish_batch(messages: DataFrame, path: str, batch: int | str) -> bool:
    """Messages (msg_id, payload) as JSON lines in the sink's folder of this
    batch. They are written aside and appear by one rename; a batch that has been
    published is left alone, so repeating a publication adds no message, for
    streams that follow the sink as well. Returns whether it was published now."""
    spark, target = messages.sparkSession, f"{path}/batch_id={batch}"
    store, aside = _Store(spark, path), f"{path}/_aside/{uuid.uuid4().hex}"
    if store.exists(target):
        return False
    messages.select("msg_id", "payload").write.json(aside)
    if store.move(aside, target):
        return True
    store.delete(aside)
    return False


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(m[1]) for n in _Store(spark, path).names(path) if (m := re.fullmatch(r"batch_id=(\d+)", n)))


def read_stored(spark: SparkSession, path: str, schema: StructType | str, before: int | None = None) -> DataFrame:
    """The table's rows with ``batch_id`` and ``event_date``: the compacted folders and
    the batches after them, or of all these only batches below ``before``. ``schema``
    is that of the columns in the files."""
    now = manifest(spark, path)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    inside = [f for f in schema.fields if f.name not in ("batch_id", "event_date")]
    own = StructType(inside).add("batch_id", IntegerType()).add("event_date", DateType())
    parts = []
    live = [f"{path}/batch_id={n}" for n in _batches(spark, path)
            if n > now.upto and (before is None or n < before)]
    if live:
        parts.append(spark.read.schema(own).option("basePath", path).parquet(*live))
    for folder in now.folders:
        parts.append(spark.read.schema(own).parquet(folder))
    if not parts:
        return spark.createDataFrame([], own)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if before is None else out.filter(F.col("batch_id") < before)


def compact_stored(spark: SparkSession, path: str, schema: StructType | str, upto: int, whole: bool = False,
                   write: Callable[[DataFrame, str], None] | None = None) -> Manifest:
    """K10 on a table in use: rewrites the batches after the last compaction up to
    ``upto`` (all done, see :func:`last_done`) into one sorted folder,
    or one that ``write`` makes, and commits it; with ``whole`` together with the earlier compacted folders.
    Returns the version
    that holds; running it again without new batches changes nothing."""
    now = manifest(spark, path)
    fresh = [n for n in _batches(spark, path) if now.upto < n <= upto]
    if not fresh and not (whole and len(now.folders) > 1):
        return now
    rows = read_stored(spark, path, schema).filter(F.col("batch_id") <= upto)
    if not whole:
        rows = rows.filter(F.col("batch_id") > now.upto)
    folder = f"{path}.compacted/{uuid.uuid4().hex}"
    (write or compact)(rows, folder)
    folders = (folder,) if whole else (*now.folders, folder)
    new = Manifest(now.version + 1, max(upto, now.upto), folders)
    _Store(spark, path).create(f"{path}.manifest/{new.version:020d}", json.dumps({"upto": new.upto, "folders": list(folders)}))
    return new


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the batch folders that compacted ones cover and the compacted folders
    that the newest version has left; returns how many. For a time when no reader
    holds an older version."""
    now, store = manifest(spark, path), _Store(spark, path)
    gone = [f"{path}/batch_id={n}" for n in _batches(spark, path) if n <= now.upto]
    gone += [f for n in store.names(f"{path}.compacted") if (f := f"{path}.compacted/{n}") not in now.folders]
    for folder in gone:
        store.delete(folder)
    return len(gone)


def drop_chunks(spark: SparkSession, path: str, as_of: str, chunk_days: int = CHUNK_SECONDS // DAY,
                keep_seconds: int = RETENTION_SECONDS) -> list[int]:
    """K8 + K9 on a table in use: drops whole time chunks, each once its end is at or
    before ``as_of`` less the retention. A chunk is a whole number of days, counted
    from 1970, so it is the day folders within its bounds, in batches and compacted
    folders alike; only folder names are read. A chunk that has begun to expire stays
    whole until it has ended. Returns the chunks that went; again, none do."""
    now, store = manifest(spark, path), _Store(spark, path)
    cutoff = (dt.datetime.fromisoformat(as_of) - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1) - keep_seconds
    gone = set()
    for folder in [*(f"{path}/batch_id={n}" for n in _batches(spark, path)), *now.folders]:
        for name in store.names(folder):
            if m := re.fullmatch(r"event_date=(\d{4}-\d\d-\d\d)", name):
                chunk = (dt.date.fromisoformat(m[1]) - dt.date(1970, 1, 1)).days // chunk_days
                if (chunk + 1) * chunk_days * DAY <= cutoff:
                    store.delete(f"{folder}/{name}")
                    gone.add(chunk)
    return sorted(gone)


def register_stored(spark: SparkSession, table: str, path: str) -> None:
    """Makes a catalog table over ``path`` (partitioned by batch_id, event_date) show
    the manifest's version: the dates of compacted folders as partitions with the
    batch numbers -1, -2, ... and the batches after them."""
    now, store = manifest(spark, path), _Store(spark, path)
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    spec = [dict(kv.split("=", 1) for kv in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    old = [s for s in spec if int(s["batch_id"]) <= now.upto]
    if old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(
            f"PARTITION (batch_id={s['batch_id']}, event_date='{s['event_date']}')" for s in old))
    for k, folder in enumerate(now.folders):
        for name in store.names(folder):
            if name.startswith("event_date="):
                spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (batch_id={-1 - k}, "
                          f"event_date='{name.split('=', 1)[1]}') LOCATION '{folder}/{name}'")
