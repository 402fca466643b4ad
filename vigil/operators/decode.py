"""Result-message codec.

Decoding is strict like the producer's typed decoder: the payload must be a
JSON object whose required fields have the right JSON types. Spark's
``from_json`` would silently turn a number into a string or a missing field
into null, so the payload is parsed once into a VARIANT and every field is
type-tested before extraction. Undecodable records go to a reject table with
a reason instead of blocking the stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import status
from vigil.functions.validate import parse_rfc3339
from vigil.schemas import STATUS_NAMES

_CHANNELS_T = "array<struct<chat_id:string,bot_token:string>>"


def encode_result(check_name: Column, output: Column, status_name: Column, ts: Column,
                  channels: Column, mute: Column, mute_until: Column) -> Column:
    """B2: JSON text of a result message (timestamps as RFC 3339, UTC)."""
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    return F.to_json(F.struct(
        check_name.alias("check_name"), output.alias("output"), status_name.alias("status"),
        F.date_format(ts, fmt).alias("timestamp"), channels.alias("telegram_channels"),
        mute.alias("mute_notifications"), F.date_format(mute_until, fmt).alias("mute_notifications_until")))


def _strings(items: Column, *fields: str) -> Column:
    """True when every element of an array of variants has JSON strings in
    ``fields`` (a number or a boolean is no string; null items fail)."""
    return F.forall(items, lambda x: reduce(lambda a, b: a & b, [
        F.coalesce(F.schema_of_variant(F.try_variant_get(x, f"$.{f}", "variant")) == "STRING", F.lit(False))
        for f in fields]))


def _all_strings(v: Column, path: str) -> Column:
    """True when the value at ``path`` is an array of JSON strings."""
    return F.forall(F.try_variant_get(v, path, "array<variant>"),
                    lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))


def utc_now() -> Column:
    """The present UTC wall-clock time, whatever the session time zone is."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.current_timestamp()),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


_FIELDS = ("check_name", "output", "status", "timestamp", "telegram_channels",
           "mute_notifications", "mute_notifications_until")


def decode_results(records: DataFrame, payload: str = "payload", as_of: str | None = None):
    """B1 + C4: (decoded, rejects(<input columns>, reason)); see :func:`tag_results`."""
    tagged = tag_results(records, payload, as_of)
    rejects = tagged.filter(F.col("_reason").isNotNull()).select(
        *records.columns, F.col("_reason").alias("reason"))
    return tagged.filter(F.col("_reason").isNull()).drop("_reason"), rejects


def tag_results(records: DataFrame, payload: str = "payload", as_of: str | None = None) -> DataFrame:
    """Every record with its decoded fields and ``_reason``, null when it is good.

    ``decoded`` has the input columns plus check_name, output, status,
    status_code, timestamp (NTZ, UTC; missing -> ``as_of``),
    telegram_channels, mute_notifications, mute_notifications_until.

    Three steps, each computed once per record: (1) parse the payload;
    (2) project every field's JSON type, text and parsed value as columns;
    (3) build the reject reason and the typed row inside a one-row generator.
    The generator stops predicate pushdown, so the good/reject filter reads
    the finished row instead of re-deriving the fields (and re-parsing).
    """
    cols = records.columns
    parsed = records.select(*cols, F.try_parse_json(F.col(payload)).alias("_v"))
    vv = F.col("_v")
    probes = [F.schema_of_variant(vv).alias("_t_")]
    probes += [_type(vv, f"$.{f}").alias(f"_t_{f}") for f in _FIELDS]
    probes += [F.try_variant_get(vv, f"$.{f}", "string").alias(f"_s_{f}")
               for f in ("check_name", "output", "status", "timestamp", "mute_notifications_until")]
    probes += [F.try_variant_get(vv, "$.telegram_channels", _CHANNELS_T).alias("_chans"),
               _strings(F.try_variant_get(vv, "$.telegram_channels", "array<variant>"), "chat_id", "bot_token")
               .alias("_chans_ok"),
               F.try_variant_get(vv, "$.mute_notifications", "boolean").alias("_mute")]
    typed = parsed.select(*cols, "_v", *probes)
    typed = typed.select(*[c for c in typed.columns if c != "_v"], vv.isNull().alias("_null"),
                         parse_rfc3339(F.col("_s_timestamp")).alias("_ts"),
                         parse_rfc3339(F.col("_s_mute_notifications_until")).alias("_until"))
    t = lambda f: F.col(f"_t_{f}")
    absent = lambda f: t(f).isNull() | (t(f) == "VOID")
    chans = F.col("_chans")
    checks = [
        ("invalid_json", F.col("_null") | ~F.coalesce(F.col("_t_").startswith("OBJECT"), F.lit(False))),
        ("bad_check_name", ~F.coalesce(t("check_name") == "STRING", F.lit(False))),
        ("bad_output", ~F.coalesce(t("output") == "STRING", F.lit(False))),
        ("bad_status", ~F.coalesce((t("status") == "STRING") & F.col("_s_status").isin(*STATUS_NAMES),
                                   F.lit(False))),
        ("bad_channels", ~F.coalesce(t("telegram_channels").startswith("ARRAY") & chans.isNotNull()
                                     & F.col("_chans_ok"), F.lit(False))),
        ("bad_timestamp", ~(absent("timestamp") | F.col("_ts").isNotNull())),
        ("bad_mute", ~(absent("mute_notifications") | (t("mute_notifications") == "BOOLEAN"))),
        ("bad_mute_until", ~(absent("mute_notifications_until") | F.col("_until").isNotNull())),
    ]
    reason = reduce(lambda acc, c: acc.when(c[1], F.lit(c[0])),
                    checks[1:], F.when(checks[0][1], F.lit(checks[0][0])))
    stamp = F.lit(as_of).cast("timestamp_ntz") if as_of else utc_now()
    row = F.struct(
        reason.alias("_reason"),
        F.col("_s_check_name").alias("check_name"),
        F.col("_s_output").alias("output"),
        F.col("_s_status").alias("status"),
        status.status_to_code(F.col("_s_status")).alias("status_code"),
        F.coalesce(F.col("_ts"), stamp).alias("timestamp"),
        chans.alias("telegram_channels"),
        F.col("_mute").alias("mute_notifications"),
        F.col("_until").alias("mute_notifications_until"))
    # second generator: the reason filter stops here and reads the typed row
    return typed.select(*cols, F.inline(F.array(row)))


def error_result(check_name: Column, message: Column, mute: Column, mute_until: Column) -> Column:
    """A CheckError result (no timestamp, no channels, mute flags kept)."""
    return F.struct(check_name.alias("check_name"), message.alias("output"),
                    F.lit("CheckError").alias("status"),
                    F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                    F.array().cast(_CHANNELS_T).alias("telegram_channels"),
                    mute.alias("mute_notifications"), mute_until.alias("mute_notifications_until"))


_TASK_CHANNELS_T = "array<struct<chat_id:string,channel_name:string>>"


def decode_tasks(records: DataFrame, payload: str = "payload"):
    """A5 + B1 for the task stream: (decoded, rejects(<input columns>, reason)).

    Required: ``passive`` (boolean), ``check_name`` (string),
    ``telegram_channels`` (array of channel objects). Optional: ``interval``
    (non-negative integer), ``script`` (object with string ``content``),
    ``secret_refs`` (array of strings: names, never values), mute flag and RFC
    3339 mute-until.
    """
    cols = records.columns
    parsed = records.select(*cols, F.try_parse_json(F.col(payload)).alias("_v"))
    vv = F.col("_v")
    fields = ("passive", "check_name", "telegram_channels", "interval", "script", "secret_refs",
              "mute_notifications", "mute_notifications_until")
    typed = parsed.select(
        *cols, vv.isNull().alias("_null"), F.schema_of_variant(vv).alias("_t_"),
        *[_type(vv, f"$.{f}").alias(f"_t_{f}") for f in fields],
        _type(vv, "$.script.content").alias("_t_content"),
        F.try_variant_get(vv, "$.check_name", "string").alias("_name"),
        F.try_variant_get(vv, "$.passive", "boolean").alias("_passive"),
        F.try_variant_get(vv, "$.interval", "bigint").alias("_interval"),
        F.try_variant_get(vv, "$.script.content", "string").alias("_content"),
        _type(vv, "$.script.python_requirements").alias("_t_reqs"),
        F.try_variant_get(vv, "$.script.python_requirements", "array<string>").alias("_reqs"),
        _all_strings(vv, "$.script.python_requirements").alias("_reqs_ok"),
        F.try_variant_get(vv, "$.secret_refs", "array<string>").alias("_refs"),
        _all_strings(vv, "$.secret_refs").alias("_refs_ok"),
        F.try_variant_get(vv, "$.telegram_channels", _TASK_CHANNELS_T).alias("_chans"),
        _strings(F.try_variant_get(vv, "$.telegram_channels", "array<variant>"), "chat_id", "channel_name")
        .alias("_chans_ok"),
        F.try_variant_get(vv, "$.mute_notifications", "boolean").alias("_mute"),
        parse_rfc3339(F.try_variant_get(vv, "$.mute_notifications_until", "string")).alias("_until"))
    t = lambda f: F.col(f"_t_{f}")
    absent = lambda f: t(f).isNull() | (t(f) == "VOID")
    chans = F.col("_chans")
    checks = [
        ("invalid_json", F.col("_null") | ~F.coalesce(F.col("_t_").startswith("OBJECT"), F.lit(False))),
        ("bad_passive", ~F.coalesce(t("passive") == "BOOLEAN", F.lit(False))),
        ("bad_check_name", ~F.coalesce(t("check_name") == "STRING", F.lit(False))),
        ("bad_channels", ~F.coalesce(t("telegram_channels").startswith("ARRAY") & chans.isNotNull()
                                     & F.col("_chans_ok"), F.lit(False))),
        ("bad_interval", ~(absent("interval") | F.coalesce((t("interval") == "BIGINT")
                                                           & (F.col("_interval") >= 0), F.lit(False)))),
        ("bad_script", ~(absent("script") | F.coalesce((t("content") == "STRING") & (
            absent("reqs") | F.col("_reqs_ok")), F.lit(False)))),
        ("bad_secret_refs", ~(absent("secret_refs") | F.coalesce(F.col("_refs_ok"), F.lit(False)))),
        ("bad_mute", ~(absent("mute_notifications") | (t("mute_notifications") == "BOOLEAN"))),
        ("bad_mute_until", ~(absent("mute_notifications_until") | F.col("_until").isNotNull())),
    ]
    reason = reduce(lambda acc, c: acc.when(c[1], F.lit(c[0])),
                    checks[1:], F.when(checks[0][1], F.lit(checks[0][0])))
    row = F.struct(reason.alias("_reason"), F.col("_name").alias("check_name"),
                   F.col("_passive").alias("passive"), F.col("_interval").alias("interval"),
                   F.col("_content").alias("script_content"), F.col("_reqs").alias("python_requirements"),
                   F.col("_refs").alias("secret_refs"),
                   chans.alias("telegram_channels"), F.col("_mute").alias("mute_notifications"),
                   F.col("_until").alias("mute_notifications_until"))
    tagged = typed.select(*cols, F.inline(F.array(row)))
    rejects = tagged.filter(F.col("_reason").isNotNull()).select(*cols, F.col("_reason").alias("reason"))
    return tagged.filter(F.col("_reason").isNull()).drop("_reason"), rejects
