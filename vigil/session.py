"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Defaults a deployment would tune per cluster; the values here fit local[N].
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "vigil", cores: int | str = "*",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, use the session the
    platform provides; the library reads every setting from it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(
        shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores)))
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local session (tests) may leave it unset and
    then gets a fresh folder under the system temp dir; on a cluster executors
    would not share such a folder, so there an unset one is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="vigil-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (unique per call)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


ADAPTIVE = ("spark.sql.adaptive.enabled", "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning")


@contextlib.contextmanager
def adaptive(spark: SparkSession):
    """Adaptive execution while a micro-batch's own jobs run, frames that it persists
    included. Else these keep ``spark.sql.shuffle.partitions`` parts however few their
    rows are, and all that reads them does; in the session of a stream with state,
    where Spark turns adaptive execution off, every shuffle does."""
    was = {k: spark.conf.get(k) for k in ADAPTIVE}
    for k in ADAPTIVE:
        spark.conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def each_batch(work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``work`` for ``foreachBatch``, its jobs run adaptively. The stream's own plan, kept
    state included, is made before and after as Spark wants it."""
    def run(batch: DataFrame, batch_id: int) -> None:
        with adaptive(batch.sparkSession):
            work(batch, batch_id)

    return run
