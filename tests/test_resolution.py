"""Resolution kept up by changes equals full resolution after every batch, and only
what depends on a change is resolved again."""

import pytest
from pyspark.sql import functions as F

from vigil.operators import registry as REG
from vigil.schemas import CHECK_SPEC
from vigil.session import scratch_path
from vigil.sinks import stored as ST
from vigil.streaming import resolution as RES

SCRIPTS = "script_name string, content string, language_label string, python_requirements array<string>"
CHANNELS = "channel_name string, chat_id string, bot_token_ref string"
SECRETS = "secret_name string, key string, value binary"


@pytest.fixture()
def world():
    """Records by kind and name; a missing name is a record that is not there."""
    check = lambda script, secrets=None, channels=None: (script is None, script, 60, secrets, channels, False, None)
    return {"check": {"plain": check("s1"), "two": check("s2", ["k1", "k2"], ["ch1"]), "talks": check("s1", None, ["ch2", "ch1"]),
                      "passive": check(None), "dangling": check("nowhere")},
            "script": {"s1": ("one", "python", None), "s2": ("two", "bash", ["lib"])},
            "channel": {"ch1": ("7", "tok"), "ch2": ("8", "tok2")},
            "secret": {"k1": {"A": b"1"}, "k2": {"B": b"2"}, "tok": {"botToken": b"t"}, "tok2": {"botToken": b"u"}}}


def _definitions(spark, w):
    rows = lambda kind: [(n, *r) for n, r in w[kind].items()]
    secrets = [(n, k, bytearray(v)) for n, kv in w["secret"].items() for k, v in kv.items()]
    return RES.Definitions(spark.createDataFrame(rows("check"), CHECK_SPEC), spark.createDataFrame(rows("script"), SCRIPTS),
                           spark.createDataFrame(rows("channel"), CHANNELS), spark.createDataFrame(secrets, SECRETS))


def _full(spark, w):
    d = _definitions(spark, w)
    out = REG.resolved_checks(d.checks, d.scripts, REG.resolve_bot_tokens(d.channels, d.secrets), d.secrets)
    return out.withColumn("secret_keys", F.when(F.col("secrets").isNotNull(), F.array_sort(F.map_keys("secrets")))).drop("secrets")


def _rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


# (change, checks that are resolved again)
STEPS = [
    (lambda w: w["script"].update(s1=("new", "python", None)), [("script", "s1")], 2),
    (lambda w: w["secret"]["k2"].update(C=b"3"), [("secret", "k2")], 1),
    (lambda w: w["secret"].update(k1={"A": b"\xff"}), [("secret", "k1")], 1),             # not UTF-8: cannot be resolved
    (lambda w: w["secret"].pop("tok"), [("secret", "tok")], 2),                           # by the channel's bot token
    (lambda w: (w["secret"].update(tok={"botToken": b"x"}), w["secret"].update(k1={"A": b"ok"})),
     [("secret", "tok"), ("secret", "k1"), ("secret", "tok")], 2),
    (lambda w: w["channel"].pop("ch2"), [("channel", "ch2")], 1),
    (lambda w: w["check"].pop("plain"), [("check", "plain")], 1),
    (lambda w: w["script"].update(nowhere=("found", "bash", None)), [("script", "nowhere")], 1),
    (lambda w: None, [("script", "unused"), ("check", None)], 0),
]


def test_only_what_depends_on_a_change_is_resolved_again(spark, world):
    base = scratch_path(spark, "resolution")
    run = lambda n, changes: RES.resolve_batch(spark.createDataFrame(changes, RES.CHANGE), n, base,
                                               lambda: _definitions(spark, world))
    run(0, [("check", n) for n in world["check"]])
    assert _rows(RES.resolved_now(spark, base)) == _rows(_full(spark, world))
    for n, (change, notices, touched) in enumerate(STEPS, 1):
        change(world)
        run(n, notices)
        assert spark.read.parquet(f"{base}/resolved/batch_id={n}").count() == touched, notices
        assert _rows(RES.resolved_now(spark, base)) == _rows(_full(spark, world)), notices
        if n == 5:
            RES.fold_resolved(spark, base)
            ST.vacuum(spark, f"{base}/resolved")
            assert _rows(RES.resolved_now(spark, base)) == _rows(_full(spark, world))
    stored = str(spark.read.schema(RES.RESOLVED).parquet(f"{base}/resolved").collect())
    assert "ok" not in stored and "secret_keys=['A', 'B', 'C']" in str(RES.resolved_now(spark, base).collect())


def test_repeating_the_last_batch_changes_nothing(spark, world):
    base = scratch_path(spark, "resolution")
    notices = spark.createDataFrame([("check", n) for n in world["check"]], RES.CHANGE)
    for _ in range(2):
        RES.resolve_batch(notices, 0, base, lambda: _definitions(spark, world))
        assert _rows(RES.resolved_now(spark, base)) == _rows(_full(spark, world))
