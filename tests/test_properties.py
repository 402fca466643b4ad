"""Property tests: the JVM-side metric parser against a plain-Python reading
of the output grammar, on generated outputs (hypothesis)."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions import perf

# Python twin of the accepted float grammar (same text as perf.FLOAT_GRAMMAR).
_FLOAT = re.compile(r"[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?"
                    r"|(?i:inf|infinity|nan))")
_WS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F))


def py_metrics(output):
    """Reference reading: text after the first '|', split on ',', tokens with
    '=', split at the first '=', trim Unicode white space, f32 or 0.0."""
    import numpy as np
    _, sep, rest = output.partition("|")
    out = []
    for tok in (rest.split(",") if sep else []):
        if "=" not in tok:
            continue
        k, _, v = tok.partition("=")
        k, v = k.strip(_WS), v.strip(_WS)
        if _FLOAT.fullmatch(v):
            low = v.lower().lstrip("+-")
            val = float("nan") if low == "nan" else float(np.float32(float(v)))
            out.append((k, val, True))
        else:
            out.append((k, 0.0, False))
    return out


ALPHABET = st.sampled_from(list("ab=,|.+-eE019 \t") + [" ", "inf", "nan", "x"])
outputs = st.lists(ALPHABET, max_size=30).map("".join)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(outputs, min_size=1, max_size=40))
def test_metric_parse_matches_python(spark, batch):
    df = spark.createDataFrame([(i, o) for i, o in enumerate(batch)], "i int, o string")
    rows = df.select("i", perf.display_text(F.col("o")).alias("t"),
                     perf.metric_entries(F.col("o")).alias("m")).collect()
    for r in rows:
        raw = batch[r.i]
        assert r.t == raw.split("|", 1)[0]
        got = [(e.perf_key, e.perf_value, e.parse_ok) for e in r.m]
        want = py_metrics(raw)
        assert len(got) == len(want), raw
        for (gk, gv, gok), (wk, wv, wok) in zip(got, want):
            assert (gk, gok) == (wk, wok), raw
            assert (math.isnan(gv) and math.isnan(wv)) or gv == wv, raw


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(outputs, min_size=1, max_size=40))
def test_long_form_matches_python(spark, batch):
    import datetime as dt

    from vigil.operators import results as R
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(ts, f"c{i}", o) for i, o in enumerate(batch)],
                               "ts timestamp_ntz, check_name string, output string")
    got = {}
    for r in R.perf_rows(df, keep_first=False).collect():
        got.setdefault(r.check_name, []).append((r.pos, r.perf_key, r.perf_value, r.parse_ok))
    for i, raw in enumerate(batch):
        g = [x[1:] for x in sorted(got.get(f"c{i}", []))]
        want = py_metrics(raw)
        assert [(k, ok) for k, _, ok in g] == [(k, ok) for k, _, ok in want], raw
        for (_, gv, _), (_, wv, _) in zip(g, want):
            assert (math.isnan(gv) and math.isnan(wv)) or gv == wv, raw
