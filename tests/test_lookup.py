"""Look-ups of a batch in a large stored table."""

from pyspark.sql import functions as F

from vigil.operators.lookup import may_match
from vigil.session import scratch_path
from vigil.streaming import ingest as ING

KEY = ["name", "t"]


def _table(spark, n):
    return spark.range(n).select(F.concat(F.lit("c"), F.col("id") % 50).alias("name"),
                                 F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), "id")


def test_the_sieve_lets_every_match_pass_and_few_others(spark):
    table = _table(spark, 20_000)
    keys = table.filter("id % 10 = 3 or id = 4").select(*KEY).unionByName(
        spark.sql("select cast(null as string) name, timestamp_ntz'2024-01-01' t"))
    near = may_match(table, keys, KEY)
    assert near.columns == table.columns
    assert near.join(keys, KEY, "left_semi").count() == 2_001
    assert near.count() < 2_200
    assert may_match(table, keys.limit(0), KEY).count() == 0
    assert may_match(table, table, KEY).count() == 20_000


def test_a_batch_shuffles_its_own_keys_and_not_the_store(spark):
    """Of 3,000 stored keys, the look-up of a batch with three of them gives little more."""
    base = scratch_path(spark, "lookup")
    line = ('{"check_name":"c%d","output":"x","status":"Ok","telegram_channels":[],'
            '"timestamp":"2024-01-0%dT00:00:00Z"}')
    stored = [(k, line % (k, 1 + k % 3)) for k in range(3000)]
    ING.process_batch(spark.createDataFrame(stored, "msg_id long, payload string"), 0, base)
    again = stored[:3] + [(5000, line % (5000, 1)), (5001, line % (5001, 2)), (5002, line % (5002, 3))]
    batch = spark.createDataFrame(again, "msg_id long, payload string")
    prior = ING._stored_keys(ING._decoded(batch, None), f"{base}/check_result", 1)
    assert {"c0", "c1", "c2"} <= {r.check_name for r in prior.collect()} and prior.count() < 30
    ING.process_batch(batch, 1, base)
    assert spark.read.parquet(f"{base}/check_result").count() == 3003
    assert [r.msg_id for r in spark.read.parquet(f"{base}/quarantine").orderBy("msg_id").collect()] == [0, 1, 2]


def test_submissions_meet_the_registry_without_the_driver(spark, monkeypatch):
    path = scratch_path(spark, "registry")
    spark.createDataFrame([("a",), ("b",)], "check_name string").selectExpr(
        "check_name", "array(named_struct('chat_id', '1', 'bot_token', 't')) channels", "false mute",
        "cast(null as timestamp_ntz) mute_until").write.parquet(path)
    checks = spark.read.parquet(path)
    batch = spark.createDataFrame([(1, "a", 2), (2, "zz", 0), (3, None, 0)], "submission_id long, check_name string, status int").select(
        "submission_id", F.expr("timestamp_ntz'2024-01-01'").alias("received_at"), "check_name", F.lit("x").alias("output"),
        "status", F.lit(None).cast("string").alias("image_jpg_base64"))
    seen = []
    monkeypatch.setattr(ING, "_store_rows", lambda rows, *_: seen.append(rows))
    ING.process_submissions(batch, 0, "unused", lambda: checks)
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.msg_id, r._reason) for r in seen[0].collect()) == [(1, None), (2, "unknown_check"), (3, "unknown_check")]
