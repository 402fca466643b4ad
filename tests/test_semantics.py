"""Golden semantics of folds, decisions, schedules, as-of join, decoding and
streaming replay (FIXTURES.md §3), checked on small frames and against
brute-force Python where SQL cannot express the operator."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from conftest import SF001
from vigil.operators import alerts as A
from vigil.operators import decode as DEC
from vigil.operators import mute as M
from vigil.operators import registry as REG
from vigil.operators import schedule as S

T0 = dt.datetime(2024, 1, 1)
U1 = "2024-02-01T00:00:00Z"


def _registry(spark, names=("c1",)):
    return spark.createDataFrame([(n, None, None) for n in names],
                                 "check_name string, mute boolean, mute_until timestamp_ntz")


def _fold(spark, cmds):
    rows = [(i, "c1", op, until) for i, (op, until) in enumerate(cmds)]
    c = spark.createDataFrame(rows, "seq long, check_name string, op string, until string")
    reg = _registry(spark)
    acc, rej = M.split_commands(reg, c)
    r = M.mute_state(reg, acc).first()
    return r.muted, r.muted_until, rej.count()


def test_mute_fold_golden(spark):
    u1 = dt.datetime(2024, 2, 1)
    assert _fold(spark, [("mute", None)]) == (True, None, 0)
    assert _fold(spark, [("mute", None), ("mute", U1)]) == (True, u1, 0)
    assert _fold(spark, [("mute", U1), ("mute", None)]) == (True, u1, 0)
    assert _fold(spark, [("mute", U1), ("unmute", None)]) == (False, None, 0)
    assert _fold(spark, [("mute", U1), ("unmute", None), ("mute", None)]) == (True, None, 0)
    assert _fold(spark, [("mute", "not-a-date")]) == (None, None, 1)


def test_mute_unknown_check_rejected(spark):
    c = spark.createDataFrame([(1, "nope", "mute", None)], "seq long, check_name string, op string, until string")
    acc, rej = M.split_commands(_registry(spark), c)
    assert acc.count() == 0 and rej.first().reason == "unknown_check"


def test_send_decision_golden(spark):
    t = dt.datetime(2024, 1, 10)
    cases = [("Ok", None, None, False), ("Pending", True, None, False),
             ("Warning", None, None, True), ("Critical", False, t + dt.timedelta(days=1), True),
             ("CheckError", True, None, False), ("Warning", True, t + dt.timedelta(days=1), False),
             ("Warning", True, t, True), ("Critical", True, t - dt.timedelta(days=1), True)]
    df = spark.createDataFrame([(i, s, m, u, t) for i, (s, m, u, _) in enumerate(cases)],
                               "i int, s string, m boolean, u timestamp_ntz, t timestamp_ntz")
    got = [r.x for r in df.orderBy("i").select(
        A.should_send(F.col("s"), F.col("m"), F.col("u"), F.col("t")).alias("x")).collect()]
    assert got == [c[3] for c in cases]


def test_spec_validity_golden(spark):
    rows = [("a", True, None, None), ("b", False, "s", 300), ("c", None, "s", None), ("d", False, None, 300)]
    df = spark.createDataFrame(rows, "check_name string, passive boolean, script_ref string, check_interval long")
    valid, rejects = REG.validate_specs(df)
    assert sorted(r.check_name for r in valid.collect()) == ["a", "b"]
    assert sorted(r.check_name for r in rejects.collect()) == ["c", "d"]


def test_schedule_golden(spark):
    checks = spark.createDataFrame([("a", False, 300), ("p", True, None), ("n", False, None)],
                                   "check_name string, passive boolean, check_interval long")
    runs = S.plan(checks, "2024-01-01 00:00:00", "2024-01-01 00:10:00").orderBy("run_at").collect()
    assert [(r.check_name, r.run_at) for r in runs] == [("a", T0 + dt.timedelta(minutes=5)),
                                                        ("a", T0 + dt.timedelta(minutes=10))]

def test_asof_join_matches_brute_force_with_hot_key(spark):
    rnd = random.Random(7)
    versions = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", i,
                 T0 + dt.timedelta(minutes=rnd.randint(0, 3 * 24 * 60)), rnd.random() < 0.5) for i in range(400)]
    events = [(j, "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 6)}",
               T0 + dt.timedelta(minutes=rnd.randint(0, 3 * 24 * 60))) for j in range(3000)]
    v = spark.createDataFrame(versions, "k string, seq long, valid_from timestamp_ntz, mute boolean")
    e = spark.createDataFrame(events, "id long, k string, ts timestamp_ntz")
    got = {r.id: r.seq for r in A.asof_join(e, v, "k", "ts", "valid_from", "seq", ["seq", "mute"]).collect()}
    for j, k, ts in events:
        cands = [(vf, s) for kk, s, vf, _ in versions if kk == k and vf <= ts]
        assert got[j] == (max(cands)[1] if cands else None)


def test_decode_edge_cases(spark):
    ok = ('{"check_name":"a","output":"x|k=1","status":"Warning","timestamp":"2024-01-01t00:00:00z",'
          '"telegram_channels":[]}')
    rows = [(1, ok), (2, None), (3, "[]"), (4, "null"), (5, ok.replace('"a"', "5")),
            (6, ok.replace('"Warning"', '"Bad"')), (7, ok.replace("2024-01-01t00:00:00z", "2024-01-01")),
            (8, ok.replace('"telegram_channels":[]', '"telegram_channels":[{"chat_id":"1"}]')),
            (9, ok.replace(',"timestamp":"2024-01-01t00:00:00z"', ""))]
    df = spark.createDataFrame(rows, "msg_id long, payload string")
    good, rej = DEC.decode_results(df, as_of="2024-05-05 00:00:00")
    g = {r.msg_id: r for r in good.collect()}
    assert sorted(g) == [1, 9]
    assert g[1].timestamp == T0 and g[1].status_code == 1
    assert g[9].timestamp == dt.datetime(2024, 5, 5)
    reasons = {r.msg_id: r.reason for r in rej.collect()}
    assert reasons == {2: "invalid_json", 3: "invalid_json", 4: "invalid_json", 5: "bad_check_name",
                       6: "bad_status", 7: "bad_timestamp", 8: "bad_channels"}


def test_ingest_replay_adds_nothing(spark):
    """Stream = batch, and a rerun on the same checkpoint adds 0 rows; a
    replayed batch id rewrites its own folder with the same rows."""
    from vigil.operators.decode import decode_results
    from vigil.session import scratch_path
    from vigil.sources import fixtures as fx
    from vigil.streaming import ingest as ING
    base = scratch_path(spark, "replay")
    payloads = fx.result_payloads(spark, SF001)
    for k in range(3):       # three files written one after another
        payloads.filter(F.col("msg_id") % 3 == k).coalesce(1).write.mode("append").json(f"{base}/src")
    counts = []
    for _ in range(2):
        q = ING.start_ingest(spark, f"{base}/src", f"{base}/t", f"{base}/ckpt",
                             as_of="2024-01-31 00:00:00", max_files_per_trigger=1)
        q.awaitTermination()
        counts.append(spark.read.parquet(f"{base}/t/check_result").count())
    good, _ = decode_results(spark.read.schema("msg_id BIGINT, payload STRING").json(f"{base}/src"),
                             as_of="2024-01-31 00:00:00")
    want = good.count()
    assert counts == [want, want] and want > 0
    # replay the first batch by hand with the same file: nothing changes
    import os
    local = f"{base}/src".replace("file:", "", 1)
    files = [os.path.join(local, f) for f in os.listdir(local) if f.endswith(".json")]
    first = min(files, key=os.path.getmtime)          # the file source reads oldest first
    one = spark.read.schema("msg_id BIGINT, payload STRING").json(first)
    before = spark.read.parquet(f"{base}/t/check_result").filter("batch_id = 0").count()
    ING.process_batch(one, 0, f"{base}/t", as_of="2024-01-31 00:00:00")
    assert spark.read.parquet(f"{base}/t/check_result").count() == want
    assert spark.read.parquet(f"{base}/t/check_result").filter("batch_id = 0").count() == before


MESSAGE = '{"check_name":"a","output":"x|k=1,k=2","status":"Warning","telegram_channels":[]%s}'


def test_replay_on_another_date_replaces_the_batch(spark):
    """Messages without a time are stamped on receipt (C5); a replay past
    midnight must not leave the rows of the day before."""
    from vigil.session import scratch_path
    from vigil.streaming import ingest as ING
    base = scratch_path(spark, "midnight")
    batch = spark.createDataFrame([(1, MESSAGE % "")], "msg_id long, payload string")
    for stamp in ("2024-01-31 23:59:59", "2024-02-01 00:00:01"):
        ING.process_batch(batch, 0, base, as_of=stamp)
    for output in ("check_result", "check_result_perf_data"):
        assert [r.event_date for r in spark.read.parquet(f"{base}/{output}").collect()] == [dt.date(2024, 2, 1)]


def test_one_message_id_twice_in_a_batch_is_stored_once(spark):
    from vigil.session import scratch_path
    from vigil.streaming import ingest as ING
    base = scratch_path(spark, "twice")
    row = (7, MESSAGE % ',"timestamp":"2024-01-01T00:00:00Z"')
    ING.process_batch(spark.createDataFrame([row, row, (9, row[1])], "msg_id long, payload string"), 0, base)
    assert spark.read.parquet(f"{base}/check_result").count() == 1
    assert spark.read.parquet(f"{base}/check_result_perf_data").count() == 1
    rejected = spark.read.parquet(f"{base}/quarantine").collect()
    assert sorted((r.msg_id, r.reason) for r in rejected) == [(7, "duplicate"), (9, "duplicate")]


def test_dedup_breaks_ties_and_keeps_null_keys(spark):
    from vigil.operators.dedup import dedup_results
    rows = [(1, "a", T0), (1, "a", T0), (0, None, T0), (2, None, T0), (3, "a", None)]
    df = spark.createDataFrame(rows, "arrival long, check_name string, timestamp timestamp_ntz")
    kept, dups = dedup_results(df)
    key = lambda r: (r[0], str(r[1]), str(r[2]))
    assert sorted(map(tuple, kept.collect()), key=key) == sorted([rows[0], rows[2], rows[4]], key=key)
    assert sorted(map(tuple, dups.collect()), key=key) == sorted([rows[1], rows[3]], key=key)


def test_repeated_result_does_not_stop_history(spark):
    from vigil.operators import results as R
    df = spark.createDataFrame([(T0, "c", "x|a=1,b=2"), (T0, "c", "x|a=1,b=2")],
                               "ts timestamp_ntz, check_name string, output string")
    rows = R.perf_history(R.perf_rows(df)).collect()
    assert [dict(r.perf_data) for r in rows] == [{"a": 1.0, "b": 2.0}]


def test_sorted_history_is_in_time_order(spark):
    from vigil.plans.catalog import QUERIES
    rows = QUERIES["history_stored"](spark, SF001).collect()
    assert len(rows) > 10 and [r.timestamp for r in rows] == sorted(r.timestamp for r in rows)


def test_stored_reads_push_the_check_and_prune_days(spark):
    from vigil.plans import catalog as C
    results, metric = C._stored_tables(spark, SF001)
    assert results.count() == C.stored(spark, SF001).count() > 0
    assert metric.count() == C.metrics(spark, SF001).count() > 0
    plan = C.R.latest_one(results, "check-7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(check_name,check-7)" in plan.split("PushedFilters:")[1].split("]")[0]
    plan = C.history_stored(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "EqualTo(check_name,check-7)" in plan


def test_latest_and_fold_do_not_sort_their_input(spark):
    """The scan side of both is a hash aggregate over fixed-width values."""
    from vigil.plans import catalog as C
    for name in ("latest_all", "registry_fold"):
        plan = C.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "partial_max(" in plan
        above_scan = [x for x in plan.splitlines() if "partial_max(struct" in x.replace(" ", "")]
        assert all("Scan" not in x for x in above_scan)


def test_schedule_runs_in_buckets(spark):
    one = spark.createDataFrame([("c", False, 1)], "check_name string, passive boolean, check_interval long")
    runs = S.plan(one, "2024-01-01 00:00:00", "2024-01-01 03:00:00")
    assert runs.count() == 10_800 and runs.select("run_index").distinct().count() == 10_800
    assert runs.agg(F.max("run_at")).first()[0] == dt.datetime(2024, 1, 1, 3)
    assert S.plan(one, "2024-01-01 00:00:00", "2024-01-01 00:00:00").count() == 0


def test_strict_decode_of_nested_types(spark):
    ok = '{"check_name":"a","output":"x","status":"Ok","telegram_channels":[%s]}'
    good = '{"chat_id":"1","bot_token":"t"}'
    rows = [(1, ok % good), (2, ok % '{"chat_id":5,"bot_token":"t"}'), (3, ok % '{"chat_id":"1","bot_token":true}'),
            (4, ok % (good + ',{"chat_id":"1","bot_token":7}')), (5, ok % (good + ",null")), (6, ok % "5"),
            (7, ok % '{"chat_id":5,"bot_token":"t","more":{"chat_id":"x"}}')]
    kept, rej = DEC.decode_results(spark.createDataFrame(rows, "msg_id long, payload string"))
    assert [r.msg_id for r in kept.collect()] == [1]
    assert {r.msg_id: r.reason for r in rej.collect()} == dict.fromkeys(range(2, 8), "bad_channels")
    task = ('{"passive":false,"check_name":"a","telegram_channels":[],"secret_refs":%s,'
            '"script":{"content":"c","python_requirements":%s}}')
    rows = [(1, task % ('["k"]', '["r"]')), (2, task % ('["k",5]', "[]")), (3, task % ('{"k":"v"}', "[]")),
            (4, task % ("[]", "[1]")), (5, task % ("null", "null"))]
    kept, rej = DEC.decode_tasks(spark.createDataFrame(rows, "msg_id long, payload string"))
    assert sorted(r.msg_id for r in kept.collect()) == [1, 5]
    assert {r.msg_id: r.reason for r in rej.collect()} == {2: "bad_secret_refs", 3: "bad_secret_refs", 4: "bad_script"}


def test_missing_time_is_stamped_in_utc(spark):
    batch = spark.createDataFrame([(1, MESSAGE % "")], "msg_id long, payload string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        stamp = DEC.decode_results(batch)[0].first().timestamp
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    assert abs((now - stamp).total_seconds()) < 120


def test_tasks_hold_no_secret_values(spark):
    from vigil.plans import catalog as C
    tasks = C._tasks(spark, SF001)
    assert tasks.filter(F.col("payload").contains("token-") | F.col("payload").contains('"KEY_')).count() == 0
    assert tasks.filter(F.col("payload").contains("secret_refs")).count() > 0


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from vigil import session

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session)


def test_python_check_errors_dropped_by_default(spark):
    from vigil.operators import checks as CK
    df = spark.createDataFrame([(k, v) for k in range(6) for v in range(3)], "k long, v long")

    def fn(pdf, params):
        if (pdf["k"] == 3).any():
            raise RuntimeError("boom")
        import pandas as pd
        return pd.DataFrame({"exit_code": [0] * len(pdf), "output": ["ok|n=" + str(x) for x in pdf["n"]]})

    out = CK.python_checks(df, "k", "c-", [F.count(F.lit(1)).alias("n")], fn)
    assert sorted(r.check_name for r in out.collect()) == ["c-0", "c-1", "c-2", "c-4", "c-5"]
    side = CK.python_checks(df, "k", "c-", [F.count(F.lit(1)).alias("n")], fn, errors="side")
    res = {r.check_name: r.status_name for r in CK.to_results(side, "2024-01-01 00:00:00").collect()}
    assert res["c-3"] == "CheckError" and res["c-0"] == "Ok"


def test_failing_rows_are_found_by_halving(spark):
    """One bad row of a batch costs a few calls, not one per row."""
    from vigil.operators import checks as CK
    import pandas as pd
    calls = []

    def fn(pdf):
        calls.append(len(pdf))
        if (pdf["k"] == 77).any():
            raise RuntimeError("boom")
        return pd.DataFrame({"exit_code": [0] * len(pdf), "output": ["fine"] * len(pdf)})

    pdf = pd.DataFrame({"check_name": [f"c{k}" for k in range(128)], "k": range(128)})
    out = pd.concat(CK._bisected(pdf, fn, lambda x: x["check_name"]))
    assert len(out) == 128 and list(out[out["error"].notna()]["check_name"]) == ["c77"]
    assert len(calls) == 15


def test_script_checks_report_every_failure(spark):
    from vigil.operators import checks as CK
    from vigil.plans.catalog import _unreliable
    rows = spark.createDataFrame([(f"c{k}", "s", k, 9) for k in range(5)] + [("lost", "t", 4, 9), ("none", None, 4, 9)],
                                 "check_name string, script_ref string, r long, n long")
    good, failed = CK.outcomes(CK.script_checks(rows, {"s": _unreliable}))
    assert sorted(r.check_name for r in good.collect()) == ["c3", "c4"]
    assert {r.check_name: r.error for r in failed.collect()} == {
        "c0": "ValueError", "c1": "no_exit_code", "c2": "not_utf8", "lost": "no_script", "none": "no_script"}


def test_task_decode_rejects(spark):
    ok = '{"passive":false,"check_name":"a","interval":60,"telegram_channels":[{"chat_id":"1","channel_name":"c"}]}'
    rows = [(1, ok), (2, ok.replace('"passive":false,', "")), (3, ok.replace("60", "-1")),
            (4, ok.replace('"interval":60', '"interval":"60"')), (5, ok.replace('"a"', "1")),
            (6, ok.replace('"chat_id":"1",', "")), (7, "nope")]
    good, rej = DEC.decode_tasks(spark.createDataFrame(rows, "msg_id long, payload string"))
    assert [r.msg_id for r in good.collect()] == [1]
    assert {r.msg_id: r.reason for r in rej.collect()} == {
        2: "bad_passive", 3: "bad_interval", 4: "bad_interval", 5: "bad_check_name", 6: "bad_channels",
        7: "invalid_json"}


def test_created_tables_see_what_is_written(spark):
    from vigil.session import scratch_path
    from vigil.sinks import tables as TB
    row = spark.createDataFrame([(T0, "c", 2, "x", T0.date())],
                                "timestamp timestamp_ntz, check_name string, status smallint, output string, "
                                "event_date date")
    for database in ("vigil_one", "vigil_two"):       # one pair of tables per base
        base = scratch_path(spark, "tables")
        paths = TB.create_tables(spark, base, database)
        TB.create_tables(spark, base, database)      # second call is a no-op
        for _ in range(2):                           # and so is the replay of batch 0
            TB.write_batch(row, paths["check_result"], 0)
        TB.write_batch(row, paths["check_result"], 1)
        TB.refresh_tables(spark, database)
        table = spark.table(f"{database}.check_result")
        assert table.count() == spark.read.parquet(paths["check_result"]).count() == 2
        assert table.columns == ["timestamp", "check_name", "status", "output", "batch_id", "event_date"]


def test_failed_check_published_as_error_result(spark):
    from vigil.operators import checks as CK
    df = spark.createDataFrame([(k,) for k in range(3)], "k long")

    def fn(pdf, params):
        if (pdf["k"] == 1).any():
            raise ValueError("nope")
        import pandas as pd
        return pd.DataFrame({"exit_code": [2] * len(pdf), "output": ["bad|x=1"] * len(pdf)})

    ck = CK.python_checks(df, "k", "c-", [F.count(F.lit(1)).alias("n")], fn, errors="side")
    resolved = spark.createDataFrame([], "check_name string, channels array<struct<chat_id:string,"
                                         "channel_name:string>>, mute boolean, mute_until timestamp_ntz")
    msgs = CK.publish(ck, resolved, "2024-01-01 00:00:00")
    good, rej = DEC.decode_results(msgs.withColumnRenamed("check_name", "msg_key"), as_of="2024-02-02 00:00:00")
    got = {r.check_name: (r.status, r.timestamp) for r in good.collect()}
    assert rej.count() == 0
    assert got["c-0"] == ("Critical", T0)
    assert got["c-1"] == ("CheckError", dt.datetime(2024, 2, 2))   # no timestamp: stamped on receipt


def test_check_definitions_round_trip_json(spark):
    from vigil.session import scratch_path
    from vigil.sources import fixtures as fx
    from vigil.sources.tables import read_check_specs
    spec = fx.registry_spec(spark, SF001)
    path = scratch_path(spark, "specs")
    spec.write.json(path)
    back = read_check_specs(spark, path)
    assert back.count() == spec.count()
    assert back.exceptAll(spec.select(*back.columns)).count() == 0


def test_retention_removes_expired_days(spark):
    from vigil.plans.catalog import stored
    from vigil.session import scratch_path
    from vigil.sinks import tables as TB
    path = scratch_path(spark, "retention")
    st = stored(spark, SF001)
    TB.write_batch(st, path, 0)
    assert TB.drop_expired(path, spark, "2024-01-31 00:00:00") > 0
    want = st.filter(F.to_date("timestamp") >= dt.date(2024, 1, 24)).count()
    assert spark.read.parquet(path).count() == want > 0
    assert TB.drop_expired(path, spark, "2024-01-31 00:00:00") == 0


def test_ingest_drops_duplicates_across_batches(spark):
    from vigil.session import scratch_path
    from vigil.sources import fixtures as fx
    from vigil.streaming import ingest as ING
    base = scratch_path(spark, "xdup")
    payloads = fx.result_payloads(spark, SF001)
    # the same messages arrive twice, in two separate files / micro-batches
    payloads.coalesce(1).write.json(f"{base}/src/a")
    payloads.coalesce(1).write.json(f"{base}/src/b")
    for i, sub in enumerate(("a", "b")):
        ING.process_batch(spark.read.schema("msg_id BIGINT, payload STRING").json(f"{base}/src/{sub}"),
                          i, f"{base}/t", as_of="2024-01-31 00:00:00")
    stored = spark.read.parquet(f"{base}/t/check_result")
    assert stored.count() == stored.select("check_name", "timestamp").distinct().count() > 0
    assert stored.filter("batch_id = 1").count() == 0
    q = spark.read.parquet(f"{base}/t/quarantine/batch_id=1")
    assert q.filter("reason = 'duplicate'").count() == stored.count()
