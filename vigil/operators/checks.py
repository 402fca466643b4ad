"""User-written checks evaluated over Spark tables (L1, L2, L3).

A check maps each key of a table to (exit code, output text); the output then
goes through the same split (C1/C2) and status mapping (B3) as any result.

* SQL checks: aggregate Column expressions per key, then exit-code / output
  expressions over the aggregated row — all JVM-side, partial aggregation.
* Python checks: Spark aggregates first; the user function receives pandas
  batches of *aggregated* rows (one row per key) through ``mapInPandas``, so
  a key holding a third of the table never materialises in one pandas frame.
  ``params`` are passed to the function.
* Checks by script: rows of registered checks carry the name of their script and
  their merged secrets (D4); the function is looked up by the script's name and
  gets the rows' secrets with them (L2).
* Failures (L3): a batch whose function raises is halved until the failing rows
  stand alone. A failed row (raised, no function, no exit code, output that is
  not UTF-8) has ``error`` set and no result; :func:`outcomes` separates results
  from failures, so that failures can be stored and counted. ``errors="drop"``
  leaves failures out, as the monitored system does.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import perf, status

CHECK_OUTPUT = "check_name string, exit_code int, output string, error string"


def sql_checks(df: DataFrame, key: str, prefix: str, aggs: list[Column],
               exit_code: Column, output: Column) -> DataFrame:
    g = df.groupBy(key).agg(*aggs)
    return g.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("check_name"),
                    exit_code.cast("int").alias("exit_code"), output.alias("output"),
                    F.lit(None).cast("string").alias("error"))


def _frame(names, out: pd.DataFrame) -> pd.DataFrame:
    """Results of one call, with rows lacking an exit code or text as failures."""
    code = out["exit_code"].astype("Int32").reset_index(drop=True)
    text, error = [], []
    for value, missing in zip(out["output"], code.isna()):
        if isinstance(value, bytes):
            try:
                value = value.decode("utf-8")
            except UnicodeDecodeError:
                text.append("check failed: output is not UTF-8")
                error.append("not_utf8")
                continue
        text.append("check failed: no exit code" if missing else value)
        error.append("no_exit_code" if missing else None)
    bad = pd.Series([e is not None for e in error], dtype=bool)
    return pd.DataFrame({"check_name": list(names), "exit_code": code.mask(bad),
                         "output": text, "error": error})


def _failure(name, exc: str, message: str) -> pd.DataFrame:
    return pd.DataFrame({"check_name": [name], "exit_code": pd.array([None], dtype="Int32"),
                         "output": [f"check failed: {message}"], "error": [exc]})


def _bisected(pdf: pd.DataFrame, call, names) -> list[pd.DataFrame]:
    """``call`` on the rows, halved while it raises: a row that fails costs
    about twice the logarithm of the batch in calls, not a call per row."""
    try:
        return [_frame(names(pdf), call(pdf))]
    except Exception as exc:  # noqa: BLE001 — user code may raise anything
        if len(pdf) == 1:
            return [_failure(names(pdf).iloc[0], type(exc).__name__, f"{type(exc).__name__}: {exc}")]
        half = len(pdf) // 2
        return _bisected(pdf.iloc[:half], call, names) + _bisected(pdf.iloc[half:], call, names)


def python_checks(df: DataFrame, key: str, prefix: str, aggs: list[Column],
                  fn: Callable[[pd.DataFrame, dict], pd.DataFrame],
                  params: dict | None = None, errors: str = "drop") -> DataFrame:
    """``fn(pdf, params)`` returns a frame with ``exit_code`` and ``output``
    aligned to ``pdf``'s rows."""
    params = dict(params or {})
    g = df.groupBy(key).agg(*aggs)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.concat(_bisected(pdf, lambda x: fn(x, params), lambda x: prefix + x[key].astype(str)),
                                ignore_index=True)

    out = g.mapInPandas(run, CHECK_OUTPUT)
    return out.filter(F.col("error").isNull()) if errors == "drop" else out


def script_checks(rows: DataFrame, functions: dict[str, Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """``rows`` hold one row per check: check_name, script_ref, secrets (map) and
    whatever the functions read; the function of a row is the one registered for
    its script. Failures come out with ``error`` set."""

    def run(batches):
        for pdf in batches:
            for script, part in pdf.groupby("script_ref", dropna=False, sort=False):
                fn = functions.get(script)
                if fn is None:
                    yield pd.concat([_failure(n, "no_script", "no script") for n in part["check_name"]],
                                    ignore_index=True)
                else:
                    yield pd.concat(_bisected(part, fn, lambda x: x["check_name"]), ignore_index=True)

    return rows.mapInPandas(run, CHECK_OUTPUT)


def outcomes(checks: DataFrame):
    """(results, failures) of check outputs; count the second to see a function
    that always fails."""
    return (checks.filter(F.col("error").isNull()),
            checks.filter(F.col("error").isNotNull()).select("check_name", "error", F.col("output").alias("message")))


def to_results(checks: DataFrame, as_of: str) -> DataFrame:
    """Check outputs as result rows: a missing exit code is CheckError."""
    code = F.col("exit_code")
    return checks.select(
        "check_name", F.lit(as_of).cast("timestamp_ntz").alias("timestamp"),
        status.normalize_code(code).alias("status"),
        status.code_to_status(code).alias("status_name"),
        perf.display_text(F.col("output")).alias("text"),
        perf.metric_entries(F.col("output")).alias("entries"),
        F.col("error").isNotNull().alias("is_error"))


def publish(checks: DataFrame, resolved: DataFrame, as_of: str) -> DataFrame:
    """K4: check outputs as result-stream messages (check_name, JSON payload).

    The resolved check supplies channels and mute state, as the task would;
    tokens are not carried (S13), the channel name stands in. A check whose
    function failed (``error`` set, side-output mode) is published as the
    error result of C5: CheckError, no timestamp, no channels.
    """
    from vigil.operators.decode import encode_result, error_result
    j = checks.join(resolved.select("check_name", "channels", "mute", "mute_until"), "check_name", "left")
    chans = F.transform(F.coalesce(F.col("channels"), F.array().cast(
        "array<struct<chat_id:string,channel_name:string>>")),
        lambda c: F.struct(c["chat_id"].alias("chat_id"), c["channel_name"].alias("bot_token")))
    ok = encode_result(F.col("check_name"), F.col("output"), status.code_to_status(F.col("exit_code")),
                       F.lit(as_of).cast("timestamp_ntz"), chans, F.col("mute"), F.col("mute_until"))
    err = error_result(F.col("check_name"), F.col("output"), F.col("mute"), F.col("mute_until"))
    err_json = encode_result(err["check_name"], err["output"], err["status"], err["timestamp"],
                             err["telegram_channels"], err["mute_notifications"],
                             err["mute_notifications_until"])
    payload = F.when(F.col("error").isNotNull(), err_json).otherwise(ok)
    return j.select("check_name", payload.alias("payload"))
