"""Golden rows for the scalar functions (display text, metrics, codes, text)."""

import math

import pytest
from pyspark.sql import functions as F

from vigil.functions import perf, status, text, validate

NBSP = " "
# raw output -> (display text, [(key, value or None for NaN, parse_ok)])
GOLDEN = [
    ("OK", "OK", []),
    ("OK|a=1", "OK", [("a", 1.0, True)]),
    ("T ok!|temperature=21.5,humidity=40\n", "T ok!", [("temperature", 21.5, True), ("humidity", 40.0, True)]),
    ("|a=1", "", [("a", 1.0, True)]),
    ("x|", "x", []),
    ("x|a", "x", []),
    ("x|=5", "x", [("", 5.0, True)]),
    ("x|a=", "x", [("a", 0.0, False)]),
    ("x|a=b=c", "x", [("a", 0.0, False)]),
    ("x|k=1|z=2", "x", [("k", 0.0, False)]),
    ("x|a=1,,b=2,", "x", [("a", 1.0, True), ("b", 2.0, True)]),
    ("x| a = 1 ,\tb=" + NBSP + "2", "x", [("a", 1.0, True), ("b", 2.0, True)]),
    ("x|a=1.0f,b=1d,c=0x1p3,d=1_0", "x", [("a", 0.0, False), ("b", 0.0, False), ("c", 0.0, False), ("d", 0.0, False)]),
    ("x|a=nan,b=+nan,c=-inf,d=INFINITY,e=1e40", "x",
     [("a", None, True), ("b", None, True), ("c", -math.inf, True), ("d", math.inf, True), ("e", math.inf, True)]),
    ("x|a=-inf,b=+Infinity", "x", [("a", -math.inf, True), ("b", math.inf, True)]),
    ("x|a=.5,b=5.,c=.,d=1e,e=+3", "x", [("a", 0.5, True), ("b", 5.0, True), ("c", 0.0, False), ("d", 0.0, False), ("e", 3.0, True)]),
    ("x|a=1,a=2", "x", [("a", 1.0, True), ("a", 2.0, True)]),
    ("x|a=1;5;9", "x", [("a", 0.0, False)]),
    ("x|a=16777217", "x", [("a", 16777216.0, True)]),
    ("line \n", "line \n", []),
    ("", "", []),
]


def test_display_and_metrics(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, raw string")
    rows = df.select("i", perf.display_text(F.col("raw")).alias("t"),
                     perf.metric_entries(F.col("raw")).alias("m")).orderBy("i").collect()
    for row, (raw, want_text, want_metrics) in zip(rows, GOLDEN):
        assert row.t == want_text, raw
        got = [(e.perf_key, e.perf_value, e.parse_ok) for e in row.m]
        assert len(got) == len(want_metrics), raw
        for (gk, gv, gok), (wk, wv, wok) in zip(got, want_metrics):
            assert gk == wk and gok == wok, raw
            if wv is None:
                assert math.isnan(gv), raw
            else:
                assert gv == wv, raw
        assert [e.pos for e in row.m] == list(range(len(want_metrics)))


def test_first_per_key(spark):
    df = spark.createDataFrame([("x|a=1,b=2,a=3,b=4,c=5",)], "raw string")
    e = perf.metric_entries(F.col("raw"))
    r = df.select(perf.first_per_key(e).alias("k"), perf.later_duplicates(e).alias("d"),
                  perf.metric_map(perf.first_per_key(e)).alias("m")).first()
    assert [(x.perf_key, x.perf_value) for x in r.k] == [("a", 1.0), ("b", 2.0), ("c", 5.0)]
    assert [(x.perf_key, x.perf_value) for x in r.d] == [("a", 3.0), ("b", 4.0)]
    assert list(r.m.keys()) == ["a", "b", "c"]


def test_status_codes(spark):
    codes = [0, 1, 2, 3, 4, 5, -1, 255, None]
    want = ["Ok", "Warning", "Critical", "CheckError", "Pending", "CheckError", "CheckError", "CheckError", "CheckError"]
    stored = [0, 1, 2, 3, 4, 3, 3, 3, 3]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c int")
    rows = df.select("i", status.code_to_status(F.col("c")).alias("s"),
                     status.normalize_code(F.col("c")).alias("n")).orderBy("i").collect()
    assert [r.s for r in rows] == want
    assert [r.n for r in rows] == stored


def test_language_label(spark):
    df = spark.createDataFrame([("Python",), ("Bash",), ("Ruby",), (None,)], "l string")
    assert [r.x for r in df.select(status.language_label(F.col("l")).alias("x")).collect()] == ["python", "bash", None, None]


def test_rfc3339(spark):
    import datetime as dt
    cases = [
        ("2024-01-01T00:00:00Z", dt.datetime(2024, 1, 1)),
        ("2024-01-01T00:00:00+01:00", dt.datetime(2023, 12, 31, 23, 0)),
        ("2024-01-01T00:00:00.123456789Z", dt.datetime(2024, 1, 1, 0, 0, 0, 123456)),
        ("2024-01-01T00:00:00.1234567891Z", dt.datetime(2024, 1, 1, 0, 0, 0, 123456)),
        ("2024-01-01T00:00:00.5Z", dt.datetime(2024, 1, 1, 0, 0, 0, 500000)),
        ("2023-12-31T23:59:60Z", dt.datetime(2024, 1, 1)),
        ("2024-01-01T00:00:00+19:00", dt.datetime(2023, 12, 31, 5)),
        ("2024-01-01T00:00:00-23:59", dt.datetime(2024, 1, 1, 23, 59)),
        ("2024-01-01T00:00:00+24:00", None),
        ("2024-01-01T00:00:61Z", None),
        ("2024-01-01T24:00:00Z", None),
        ("2024-01-01T00:00:00Z\n", None),
        ("2024-01-01t10:00:00-02:30", dt.datetime(2024, 1, 1, 12, 30)),
        ("2024-01-01", None),
        ("2024-01-01T00:00:00", None),
        ("2024-13-01T00:00:00Z", None),
        ("not-a-date", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    rows = df.select("i", validate.parse_rfc3339(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p for r in rows] == [c[1] for c in cases]


def test_base64_and_utf8(spark):
    df = spark.createDataFrame([("YWI=",), ("YWI",), ("YW I=",), ("!!!",), ("",), ("YWJj",), ("YWJ=",), ("YWJj\n",),
                                ("YWJj" * 50_000,)], "t string")
    got = [r.ok for r in df.select(validate.is_strict_base64(F.col("t")).alias("ok")).collect()]
    assert got == [True, False, False, False, True, True, False, False, True]
    b = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xc3\x28"),)], "b binary")
    assert [r.s for r in b.select(validate.strict_utf8(F.col("b")).alias("s")).collect()] == ["ok", None]


def test_message(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), "check-1", "Critical", "a<b & 'c'/\"d\"")],
                               "ts timestamp_ntz, n string, s string, t string")
    r = df.select(text.alert_message(F.col("ts"), F.col("n"), F.col("s"), F.col("t")).alias("m")).first()
    assert r.m == ("<b>Date</b>: 2024-01-02 03:04:05 +00:00\n<b>Check name</b>: check-1 \n<b>Status</b>: Critical\n"
                   "<b>Output</b>\n<pre>a&lt;b &amp; &#x27;c&#x27;&#x2F;&quot;d&quot;</pre>")


def test_message_in_another_offset_converts_the_time(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 23, 4, 5),)], "ts timestamp_ntz")
    r = df.select(text.format_local(F.col("ts"), "+02:00").alias("a"), text.format_local(F.col("ts"), "-01:30").alias("b"))
    assert tuple(r.first()) == ("2024-01-03 01:04:05 +02:00", "2024-01-02 21:34:05 -01:30")


def test_parse_is_linear_in_the_text(spark):
    """Long runs of spaces, digits and commas, in keys and values."""
    import time
    long = ["x|" + " " * 100_000, "x|a=" + " " * 100_000 + "1", "x|" + " " * 100_000 + "a" + " " * 100_000 + "=1",
            "x|a=" + "1" * 100_000 + "x", "x|" + "," * 100_000 + "a=1", "x|" + ",".join(["k=1"] * 20_000)]
    df = spark.createDataFrame([(t,) for t in long], "raw string")
    expr = perf.first_per_key(perf.metric_entries(F.col("raw")))
    df.limit(1).select(expr).collect()
    start = time.time()
    rows = df.select(expr.alias("m")).collect()
    assert time.time() - start < 20
    assert [[(e.perf_key, e.perf_value) for e in r.m] for r in rows] == [
        [], [("a", 1.0)], [("a", 1.0)], [("a", 0.0)], [("a", 1.0)], [("k", 1.0)]]


def test_all_unicode_white_space_is_trimmed(spark):
    around = "".join(map(chr, (9, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    row = spark.createDataFrame([("x|" + around + "a" + around + "=" + around + "2" + around,)], "raw string")
    e = row.select(perf.metric_entries(F.col("raw")).alias("m")).first().m
    assert [(x.perf_key, x.perf_value) for x in e] == [("a", 2.0)]


def test_long_form_matches_golden(spark):
    """The codegen long form (regex extraction + explode) gives the same
    metrics as the array form, including Unicode trimming and odd tokens."""
    import datetime as dt

    from vigil.operators import results as R
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, ts, f"c{i}", g[0]) for i, g in enumerate(GOLDEN)],
                               "i int, ts timestamp_ntz, check_name string, output string")
    rows = R.perf_rows(df, keep_first=False).collect()
    got = {}
    for r in rows:
        got.setdefault(r.check_name, []).append((r.pos, r.perf_key, r.perf_value, r.parse_ok))
    for i, (raw, _, want) in enumerate(GOLDEN):
        g = sorted(got.get(f"c{i}", []))
        assert [(k, ok) for _, k, _, ok in g] == [(k, ok) for k, _, ok in want], raw
        for (_, _, gv, _), (_, wv, _) in zip(g, want):
            assert (math.isnan(gv) if wv is None else gv == wv), raw
    firsts = R.perf_rows(spark.createDataFrame([(ts, "x", "x|a=1,b=2,a=3")],
                                               "ts timestamp_ntz, check_name string, output string"))
    assert [(r.perf_key, r.perf_value) for r in firsts.orderBy("pos").collect()] == [("a", 1.0), ("b", 2.0)]


def test_row_local_history_first_occurrence_sorted(spark):
    import datetime as dt

    from vigil.operators import results as R
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(ts, "a", "x|b=2,a=1,b=3, c = oops"), (ts, "b", "no metrics"), (ts, "c", "x|k")],
                               "ts timestamp_ntz, check_name string, output string")
    rows = {r.check_name: r.perf_data for r in R.perf_history_row_local(df).collect()}
    assert list(rows) == ["a"]
    assert list(rows["a"].items()) == [("a", 1.0), ("b", 2.0), ("c", 0.0)]
