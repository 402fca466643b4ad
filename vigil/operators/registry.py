"""Check registry: validation, change-feed fold, reference resolution and
impact analysis (A1-A3, B6-B8, B11, H1, D1-D5, D9-D11).

Dimension joins carry no broadcast hint: Spark broadcasts a side only when
its size (file statistics, or AQE's runtime measurement) is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import status, validate
from vigil.schemas import BOT_TOKEN_KEY, SCRIPT_LANGUAGES


def _split_by_reasons(df: DataFrame, checks: list, key: str):
    """(valid rows, rejects(key, reason)) from (reason, failing predicate) pairs."""
    bad = [F.coalesce(pred, F.lit(False)) for _, pred in checks]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    # the valid side is a plain boolean filter (stays in codegen); only the
    # reject side builds the reason list
    valid = df.filter(~any_bad)
    reasons = F.array_compact(F.array(*[F.when(b, F.lit(name)) for (name, _), b in zip(checks, bad)]))
    rejects = df.filter(any_bad).select(key, F.explode(reasons).alias("reason"))
    return valid, rejects


def validate_specs(spec: DataFrame):
    """A check is passive, or has both a script and an interval.

    Returns (registry, rejects). ``passive`` defaults to false.
    """
    passive = F.coalesce(F.col("passive"), F.lit(False))
    spec = spec.withColumn("passive", passive)
    checks = [
        ("missing_name", F.col("check_name").isNull()),
        ("active_without_script_or_interval",
         ~F.col("passive") & (F.col("script_ref").isNull() | F.col("check_interval").isNull())),
        ("negative_interval", F.coalesce(F.col("check_interval") < 0, F.lit(False))),
    ]
    return _split_by_reasons(spec, checks, "check_name")


def validate_scripts(scripts: DataFrame):
    """Language in the declared enum and content present; adds the label."""
    checks = [
        ("missing_language", F.col("language").isNull()),
        ("bad_language", F.col("language").isNotNull() & ~F.col("language").isin(*SCRIPT_LANGUAGES)),
        ("missing_content", F.col("content").isNull()),
    ]
    valid, rejects = _split_by_reasons(scripts, checks, "script_name")
    return valid.withColumn("language_label", status.language_label(F.col("language"))), rejects


def validate_channels(channels: DataFrame):
    """A channel needs chatId and botTokenRef."""
    checks = [("missing_chat_id", F.col("chat_id").isNull()),
              ("missing_bot_token_ref", F.col("bot_token_ref").isNull())]
    return _split_by_reasons(channels, checks, "channel_name")


def fold_changes(feed: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """H1: last event per check wins; a final Remove drops the check. Every
    field of the event stays.

    The last ``seq`` per check is a hash aggregate; only the events that bear it
    are joined back and reduced (repeats of one event), so a check with a huge
    share of events never lands whole in one task. With ``keep_tombstones`` the
    Remove rows stay (column ``op``), so an incremental fold stays correct when
    older events arrive later.
    """
    cols = [c for c in feed.columns if c not in ("seq", "op", "check_name")]
    newest = feed.groupBy("check_name").agg(F.max("seq").alias("seq"))
    folded = (feed.join(newest, ["check_name", "seq"], "left_semi")
              .groupBy("check_name").agg(F.max(F.struct("seq", "op", *cols)).alias("l")))
    if keep_tombstones:
        return folded.select("check_name", "l.seq", "l.op", *[f"l.{c}" for c in cols])
    return (folded.filter(F.col("l.op") != "Remove")
            .select("check_name", "l.seq", *[f"l.{c}" for c in cols]))


def after_scan(scan: DataFrame, fence: int, feed: DataFrame) -> DataFrame:
    """A1 + A2: the events that a registry starts from: a full ``scan`` taken when the
    feed stood at number ``fence``, and the ``feed`` from anywhere before that on.

    The scan holds what events up to the fence did, also that checks were removed, so
    these events are left out however far the feed overlaps it: an old event can
    neither undo a newer one nor bring back a removed check. Scanned rows count as
    events with the number of their last change, or the fence where it is not known.
    """
    seq = F.coalesce("seq", F.lit(fence)) if "seq" in scan.columns else F.lit(fence)
    rows = scan.withColumn("seq", seq.cast("bigint")).withColumn("op", F.lit("AddOrUpdate"))
    return feed.filter(F.col("seq") > fence).unionByName(rows.select(
        *[c if c in rows.columns else F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in feed.columns]))


def resolve_scripts(registry: DataFrame, scripts: DataFrame) -> DataFrame:
    """Check -> script. A null ref is fine; a dangling ref is unresolved."""
    dim = scripts.select(F.col("script_name").alias("script_ref"),
                         F.col("content").alias("script_content"), "language_label")
    return (registry.select("check_name", "script_ref").join(dim, "script_ref", "left")
            .select("check_name", "script_ref", "script_content", "language_label",
                    (F.col("script_ref").isNull() | F.col("script_content").isNotNull())
                    .alias("script_found")))


def resolve_bot_tokens(channels: DataFrame, secrets: DataFrame) -> DataFrame:
    """D3: channel -> secret named by bot_token_ref, key botToken (lossy UTF-8)."""
    tokens = (secrets.filter(F.col("key") == BOT_TOKEN_KEY)
              .select(F.col("secret_name").alias("bot_token_ref"), F.col("value").alias("token")))
    return (channels.join(tokens, "bot_token_ref", "left")
            .select("channel_name", "chat_id", "bot_token_ref",
                    validate.lossy_utf8(F.col("token")).alias("bot_token"),
                    F.col("token").isNotNull().alias("token_found")))


def resolve_channels(registry: DataFrame, channel_tokens: DataFrame) -> DataFrame:
    """One row per (check, ref position); order kept, duplicates kept."""
    refs = registry.select("check_name", F.posexplode("channel_refs").alias("pos", "channel_ref"))
    dim = channel_tokens.select(F.col("channel_name").alias("channel_ref"), "chat_id", "token_found")
    return (refs.join(dim, "channel_ref", "left")
            .select("check_name", "pos", "channel_ref", "chat_id",
                    F.col("chat_id").isNotNull().alias("channel_found"),
                    F.coalesce(F.col("token_found"), F.lit(False)).alias("token_found")))


def merge_secrets(registry: DataFrame, secrets: DataFrame) -> DataFrame:
    """Merged secret map per check as long rows (check_name, key, value).

    Refs in order; a missing secret is skipped; a later ref wins per key.
    ``all_valid`` is false when any fetched value of the check is not UTF-8
    (that makes the whole check unresolvable, B11).
    """
    refs = registry.select("check_name", F.posexplode("secret_refs").alias("pos", "secret_name"))
    fetched = refs.join(secrets, "secret_name", "inner").withColumn(
        "text", validate.strict_utf8(F.col("value")))
    return (fetched.groupBy("check_name", "key")
            .agg(F.max(F.struct("pos", "text")).alias("w"),
                 F.min(F.col("text").isNotNull()).alias("all_valid"))
            .select("check_name", "key", F.col("w.text").alias("value"), "all_valid"))


def unresolved_refs(scripts_res: DataFrame, channels_res: DataFrame,
                    secrets_merged: DataFrame) -> DataFrame:
    """Why a check cannot be resolved: check_name, ref_kind, ref_name."""
    parts = [
        scripts_res.filter(~F.col("script_found"))
        .select("check_name", F.lit("script").alias("ref_kind"), F.col("script_ref").alias("ref_name")),
        channels_res.filter(~F.col("channel_found"))
        .select("check_name", F.lit("channel").alias("ref_kind"), F.col("channel_ref").alias("ref_name")),
        channels_res.filter(F.col("channel_found") & ~F.col("token_found"))
        .select("check_name", F.lit("bot_token").alias("ref_kind"), F.col("channel_ref").alias("ref_name")),
        secrets_merged.filter(~F.col("all_valid"))
        .select("check_name", F.lit("secret_utf8").alias("ref_kind"), F.col("key").alias("ref_name")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def resolved_checks(registry: DataFrame, scripts: DataFrame, channel_tokens: DataFrame,
                    secrets: DataFrame) -> DataFrame:
    """One nested record per resolvable check (no bot tokens in rows, S13).

    One exchange: the registry row (script resolved by a dimension join), its
    channel-ref rows and its fetched-secret rows are unioned and grouped once
    by check_name. A group holds one check's declared refs only, and the
    collects aggregate partially. Everything after the group is row-local:
    channel order by ref position, later secret ref wins per key (D4),
    unresolvable checks dropped (D1-D3, B11).
    """
    sdim = scripts.select(F.col("script_name").alias("script_ref"),
                          F.col("content").alias("script_content"), "python_requirements")
    base_t = ("struct<passive:boolean,check_interval:bigint,script_ref:string,script_content:string,"
              "python_requirements:array<string>,script_found:boolean,secret_refs:array<string>,"
              "mute:boolean,mute_until:timestamp_ntz>")
    ch_t = "struct<pos:int,chat_id:string,channel_name:string,ok:boolean>"
    sec_t = "struct<key:string,npos:int,value:string,valid:boolean>"
    none = lambda t: F.lit(None).cast(t)
    # Checks without a script stay out of the join: null refs would all meet.
    lone = registry.filter(F.col("script_ref").isNull()).select(
        "*", F.lit(None).cast("string").alias("script_content"),
        F.lit(None).cast("array<string>").alias("python_requirements"))
    scripted = registry.filter(F.col("script_ref").isNotNull()).join(sdim, "script_ref", "left")
    base = (lone.unionByName(scripted).select(
        "check_name",
        F.struct("passive", "check_interval", "script_ref", "script_content", "python_requirements",
                 (F.col("script_ref").isNull() | F.col("script_content").isNotNull()).alias("script_found"),
                 "secret_refs", "mute", "mute_until").alias("b"),
        none(ch_t).alias("ch"), none(sec_t).alias("sec")))
    cdim = channel_tokens.select(F.col("channel_name").alias("channel_ref"), "chat_id", "token_found")
    chans = (registry.select("check_name", F.posexplode("channel_refs").alias("pos", "channel_ref"))
             .join(cdim, "channel_ref", "left")
             .select("check_name", none(base_t).alias("b"),
                     F.struct("pos", "chat_id", F.col("channel_ref").alias("channel_name"),
                              (F.col("chat_id").isNotNull() & F.coalesce(F.col("token_found"), F.lit(False)))
                              .alias("ok")).alias("ch"),
                     none(sec_t).alias("sec")))
    secs = (registry.select("check_name", F.posexplode("secret_refs").alias("pos", "secret_name"))
            .join(secrets, "secret_name", "inner")
            .withColumn("text", validate.strict_utf8(F.col("value")))
            .select("check_name", none(base_t).alias("b"), none(ch_t).alias("ch"),
                    F.struct("key", (-F.col("pos")).alias("npos"), F.col("text").alias("value"),
                             F.col("text").isNotNull().alias("valid")).alias("sec")))
    g = (base.unionByName(chans).unionByName(secs).groupBy("check_name")
         .agg(F.max("b").alias("b"), F.collect_list("ch").alias("chs"),
              F.collect_list("sec").alias("secs")))
    # secrets: sort by (key, -pos) and keep the first entry of every key
    srt = g.select("check_name", "b", "chs", F.sort_array("secs").alias("ss"))
    first_sec = F.filter("ss", lambda x, i: (i == 0) | (F.element_at("ss", i)["key"] != x["key"]))
    empty_map = F.create_map().cast("map<string,string>")
    out = srt.select(
        "check_name", "b",
        F.transform(F.sort_array("chs"), lambda x: F.struct(
            x["chat_id"].alias("chat_id"), x["channel_name"].alias("channel_name"))).alias("channels"),
        F.when(F.col("b.secret_refs").isNotNull(), F.map_from_entries(F.transform(first_sec, lambda x: F.struct(
            x["key"].alias("k"), x["value"].alias("v"))))).alias("secrets"),
        F.forall("chs", lambda x: x["ok"]).alias("channels_ok"),
        F.forall("ss", lambda x: x["valid"]).alias("secrets_ok"))
    out = out.filter(F.col("b").isNotNull() & F.col("b.script_found") & F.col("channels_ok")
                     & F.col("secrets_ok"))
    return out.select(
        "check_name", F.col("b.passive").alias("passive"),
        F.col("b.check_interval").alias("check_interval"),
        F.col("b.script_ref").alias("script_ref"),
        F.when(F.col("b.script_content").isNotNull(),
               F.struct(F.col("b.script_content").alias("content"),
                        F.col("b.python_requirements").alias("python_requirements"))).alias("script"),
        F.col("b.secret_refs").alias("secret_refs"),
        F.when(F.col("b.secret_refs").isNotNull(), F.coalesce(F.col("secrets"), empty_map)).alias("secrets"),
        "channels", F.col("b.mute").alias("mute"), F.col("b.mute_until").alias("mute_until"))


def impacted(registry: DataFrame, changed: DataFrame, kind: str) -> DataFrame:
    """Checks affected by changed scripts / secrets / channels.

    ``changed`` has one column ``name``. Secrets count only through a check's
    secret refs (not through a channel's bot token). Returns (name, check_name),
    one row per pair.
    """
    if kind == "script":
        refs = registry.select(F.col("script_ref").alias("name"), "check_name")
    elif kind == "secret":
        refs = registry.select(F.explode("secret_refs").alias("name"), "check_name").distinct()
    elif kind == "channel":
        refs = registry.select(F.explode("channel_refs").alias("name"), "check_name").distinct()
    else:
        raise ValueError(kind)
    return refs.join(changed.select("name").distinct(), "name", "inner")
