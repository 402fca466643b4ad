"""Mute / unmute command fold.

Semantics: ``mute`` sets the flag and, only when it carries ``until``,
replaces the until time (a bare mute keeps an earlier until); ``unmute``
clears both. Commands on unknown checks or with an unparseable ``until`` are
rejected and leave the state unchanged. The fold starts from the registry's
declared state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.validate import parse_rfc3339

_INIT_SEQ = -(2 ** 63)


def parsed_commands(commands: DataFrame) -> DataFrame:
    """``commands`` with ``until_ts`` and ``bad_until``, row by row."""
    parsed = commands.withColumn("until_ts", F.when(F.col("op") == "mute", parse_rfc3339(F.col("until"))))
    # A generator of one row, so that the time is parsed once and not for each use.
    rows = parsed.select(*commands.columns, F.explode(F.array("until_ts")).alias("until_ts"))
    return rows.withColumn("bad_until", (F.col("op") == "mute") & F.col("until").isNotNull() & F.col("until_ts").isNull())


def well_formed(commands: DataFrame) -> DataFrame:
    """The commands whose ``until`` can be read, for :func:`mute_state`; that leaves
    out commands on unknown checks itself, so they need no join before it."""
    return parsed_commands(commands).filter(~F.col("bad_until"))


def tagged_commands(registry: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands`` with ``until_ts`` and ``reason``: null where a command is accepted,
    ``unknown_check`` or ``bad_until`` where it is rejected. The names meet in one
    shuffle join: a registry's names grow with it and are not sent to the driver."""
    names = registry.select("check_name", F.lit(True).alias("_known")).distinct().hint("merge")
    reason = F.when(F.col("_known").isNull(), F.lit("unknown_check")).when(F.col("bad_until"), F.lit("bad_until"))
    return (parsed_commands(commands).join(names, "check_name", "left")
            .withColumn("reason", reason).drop("_known", "bad_until"))


def split_commands(registry: DataFrame, commands: DataFrame):
    """(accepted commands with ``until_ts``, rejects(seq, check_name, reason))."""
    return split_tagged(tagged_commands(registry, commands))


def split_tagged(tagged: DataFrame):
    """:func:`split_commands` of commands that are tagged already."""
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()).select("seq", "check_name", "reason"))


def mute_state(registry: DataFrame, accepted: DataFrame) -> DataFrame:
    """Final (muted, muted_until) of every registered check; commands on others
    play no part.

    One partial hash aggregation per check over (registry state + commands): the
    flag is the last command's op; the until is the value of the last row that
    sets it (a mute with until, an unmute clearing it, or the declared until).
    A check with most of the commands still costs one row per map task.
    """
    init = registry.select(
        "check_name", F.lit(_INIT_SEQ).cast("bigint").alias("seq"), F.lit("init").alias("op"),
        F.col("mute_until").alias("u"), F.col("mute_until").isNotNull().alias("sets_until"),
        F.col("mute").alias("declared"))
    cmds = accepted.select(
        "check_name", F.col("seq").cast("bigint").alias("seq"), "op",
        F.when(F.col("op") == "unmute", F.lit(None)).otherwise(F.col("until_ts")).alias("u"),
        ((F.col("op") == "unmute") | F.col("until_ts").isNotNull()).alias("sets_until"),
        F.lit(None).cast("boolean").alias("declared"))
    rows = init.unionByName(cmds).withColumn(
        "op_code", F.when(F.col("op") == "init", 0).when(F.col("op") == "mute", 1).otherwise(2))
    # fixed-width buffers only (max_by over int / timestamp, max, count), so
    # Spark uses a hash aggregate; max_by keeps a null value at the maximum,
    # which is how an unmute clears the until time
    agg = rows.groupBy("check_name").agg(
        F.max_by("op_code", "seq").alias("last_op"),
        F.max_by("u", F.when(F.col("sets_until"), F.col("seq"))).alias("until"),
        F.max("declared").alias("declared"),
        F.count_if(F.col("op_code") != 0).alias("n_commands"),
        F.max(F.col("op_code") == 0).alias("registered"))
    return agg.filter("registered").select(
        "check_name",
        F.when(F.col("last_op") == 0, F.col("declared"))
        .otherwise(F.col("last_op") == 1).alias("muted"),
        F.col("until").alias("muted_until"),
        F.col("n_commands").cast("bigint").alias("n_commands"))


# What commands do to a check's state, as a row that can be merged with others.
EFFECT = ("check_name string, last_seq bigint, muted boolean, until_seq bigint, muted_until timestamp_ntz, "
          "n_commands bigint")


def effects(accepted: DataFrame) -> DataFrame:
    """One row of :data:`EFFECT` per accepted command: its flag counts at its number;
    its until too if it sets one, or clears it as an unmute does."""
    unmute = F.col("op") == "unmute"
    seq = F.col("seq").cast("bigint")
    return accepted.select(
        "check_name", seq.alias("last_seq"), (~unmute).alias("muted"),
        F.when(unmute | F.col("until_ts").isNotNull(), seq).alias("until_seq"),
        F.when(~unmute, F.col("until_ts")).alias("muted_until"), F.lit(1).cast("bigint").alias("n_commands"))


def merge_effects(rows: DataFrame) -> DataFrame:
    """One row of :data:`EFFECT` per check, whatever order or grouping rows come in;
    a hash aggregate over fixed-width values with partial sums per task."""
    return rows.groupBy("check_name").agg(
        F.max("last_seq").alias("last_seq"), F.max_by("muted", "last_seq").alias("muted"),
        F.max("until_seq").alias("until_seq"), F.max_by("muted_until", "until_seq").alias("muted_until"),
        F.sum("n_commands").alias("n_commands"))


def applied(registry: DataFrame, merged: DataFrame) -> DataFrame:
    """Mute state of every registered check: the declared one, and over it what
    merged commands did. Equals :func:`mute_state` over the same commands."""
    names = merged.select("check_name", "muted", "until_seq", F.col("muted_until").alias("set_until"), "n_commands")
    return registry.select("check_name", "mute", "mute_until").join(names, "check_name", "left").select(
        "check_name",
        F.when(F.col("n_commands").isNull(), F.col("mute")).otherwise(F.col("muted")).alias("muted"),
        F.when(F.col("until_seq").isNull(), F.col("mute_until")).otherwise(F.col("set_until")).alias("muted_until"),
        F.coalesce("n_commands", F.lit(0).cast("bigint")).alias("n_commands"))
