"""Point reads of a compacted table: rows that the scan gives, not only pushed filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.operators import results as R
from vigil.session import scratch_path
from vigil.sinks import tables as TB

N = 200_000


def _rows_read(df):
    """Rows out of the scans of a query that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        inner = getattr(leaf, "plan", None)
        while leaf.getClass().getSimpleName().endswith("QueryStageExec"):
            leaf = inner().collectLeaves().apply(0)
            inner = getattr(leaf, "plan", None)
        total += leaf.metrics().apply("numOutputRows").value()
    return total


def _table(spark, name):
    path = scratch_path(spark, "skipping")
    day = F.lit(dt.date(2024, 1, 1))
    TB.compact(spark.range(N).select(
        F.timestamp_add("SECOND", F.col("id") % 86400, day.cast("timestamp_ntz")).alias("timestamp"), name.alias("check_name"),
        F.lit(0).cast("short").alias("status"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("output"),
        day.alias("event_date")), path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("check, want", [("check-7", N // 100), ("check-none", 0)])
def test_a_check_of_few_is_read_by_its_pages(spark, check, want):
    t = _table(spark, F.concat(F.lit("check-"), (F.col("id") % 100).cast("string")))
    df = t.filter(F.col("check_name") == check)
    assert _rows_read(df) <= want + 40_000 and df.count() == want       # at most two pages more than its rows
    assert R.latest_one(t, check).count() == min(want, 1)


def test_a_name_that_is_not_there_reads_nothing(spark):
    """Every name is another one and the name asked for lies in the range of all."""
    t = _table(spark, F.concat(F.lit("check-"), F.sha1(F.col("id").cast("string"))))
    df = t.filter(F.col("check_name") == "check-8")
    assert _rows_read(df) == 0
    there = t.filter(F.col("check_name") == t.first()["check_name"])
    assert 0 < _rows_read(there) <= 40_000 and there.count() == 1
