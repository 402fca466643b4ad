"""Check-system records derived from the given tables.

Every view reads whole tables; ``%`` only derives attribute values, never
filters rows. The same definitions exist as DuckDB SQL in
``vigil.plans.oracle`` (the correctness oracle).

results       <- events    one check result per event
registry_spec <- customer  one check definition per customer
scripts       <- part      one script per part
channels      <- supplier  one notification channel per supplier
secrets       <- nation + region
mute_commands <- orders    one mute / unmute command per order
versions      <- orders    registry versions (mute state over time)
spec_feed     <- orders    registry change feed
submissions   <- events    externally submitted (passive) results
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.tables import table  # noqa: F401 (re-exported)

# Fixed parameters of the derived data.
EPOCH = "2024-01-01 00:00:00"        # start of the result period
MONTH_SECONDS = 30 * 24 * 3600       # spread of registry versions
CHANGE_STEP_SECONDS = 60             # spacing of change-feed events


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _epoch() -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz")


def _result_columns() -> list[Column]:
    eid, et = F.col("event_id"), F.col("event_type")
    k = _s(eid % 100)
    output = (F.when(eid % 11 == 0, et)
              .when(eid % 13 == 0, F.concat(et, F.lit("|k="), k, F.lit("|z=1")))
              .when(eid % 7 == 0, F.concat(et, F.lit(" <b>|value=oops, k = "), k, F.lit(" ,junk")))
              .otherwise(F.concat(et, F.lit("|value="),
                                  _s(F.round(F.col("value") * 100).cast("bigint")),
                                  F.lit(",k="), k)))
    code = (F.when(et == "view", 0).when(et == "click", 1).when(et == "error", 2)
            .when(et == "purchase", 7).when(et == "signup", 4)).cast("int")
    return [eid.alias("event_id"), F.col("ts"),
            F.concat(F.lit("check-"), _s("user_id")).alias("check_name"),
            code.alias("status_code"), output.alias("output")]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, check_name, status_code, output."""
    return table(spark, sf_dir, "events").select(*_result_columns())


def registry_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check_name, passive, check_interval, script_ref, channel_refs,
    secret_refs, mute, mute_until — as declared (before validation)."""
    c = table(spark, sf_dir, "customer")
    key, seg, bal = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    passive = key % 5 == 0
    interval = (F.when(passive, F.lit(None))
                .when(bal < 0, F.lit(None))                     # invalid: active, no interval
                .otherwise(60 * (1 + key % 10))).cast("bigint")
    script_ref = (F.when(passive, F.lit(None))
                  .when((seg == "MACHINERY") & (bal < 1000),
                        F.concat(F.lit("script-retired-"), _s(key % 25)))
                  .otherwise(F.concat(F.lit("script-"), _s(key % 25))))
    ch1 = F.when(key % 4 != 0, F.concat(F.lit("channel-"), _s(key % 8)))
    ch2 = F.when(key % 3 == 0, F.when(seg == "AUTOMOBILE", F.lit("channel-legacy"))
                 .otherwise(F.concat(F.lit("channel-"), _s(key % 7))))
    channel_refs = F.filter(F.array(ch1, ch2), lambda x: x.isNotNull())
    secret_refs = F.when(seg != "HOUSEHOLD", F.array(
        F.concat(F.lit("secret-"), _s(key % 6)), F.concat(F.lit("secret-"), _s(key % 9))))
    mute = F.when(key % 3 == 0, F.lit(True)).when(key % 3 == 1, F.lit(False))
    mute_until = F.when(key % 6 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return c.select(F.concat(F.lit("check-"), _s(key)).alias("check_name"),
                    passive.alias("passive"), interval.alias("check_interval"),
                    script_ref.alias("script_ref"), channel_refs.alias("channel_refs"),
                    secret_refs.alias("secret_refs"), mute.alias("mute"),
                    mute_until.alias("mute_until"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    lang = (F.when(size % 10 == 0, F.lit("Ruby")).when(size % 3 == 0, F.lit("Bash"))
            .otherwise(F.lit("Python")))
    reqs = F.when((lang == "Python") & (size % 5 == 0), F.array(F.lit("requests"), F.concat(F.lit("lib-"), _s(size))))
    return p.select(F.concat(F.lit("script-"), _s("p_partkey")).alias("script_name"),
                    lang.alias("language"), F.col("p_name").alias("content"), reqs.alias("python_requirements"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("channel-"), _s("s_suppkey")).alias("channel_name"),
                    F.concat(F.lit("-100"), _s("s_suppkey")).alias("chat_id"),
                    F.when(F.col("s_suppkey") % 50 != 49,
                           F.concat(F.lit("secret-"), _s(F.col("s_nationkey") % 6))).alias("bot_token_ref"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secret_name, key, value (binary). One value is not valid UTF-8."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    nk = F.col("n_nationkey")
    kv = n.select(F.concat(F.lit("secret-"), _s(nk % 6)).alias("secret_name"),
                  F.concat(F.lit("KEY_"), _s(F.floor(nk / 6).cast("int"))).alias("key"),
                  F.when(nk == 23, F.unhex(F.lit("C328")))
                  .otherwise(F.col("n_name").cast("binary")).alias("value"))
    tokens = r.select(F.concat(F.lit("secret-"), _s("r_regionkey")).alias("secret_name"),
                      F.lit("botToken").alias("key"),
                      F.concat(F.lit("token-"), F.col("r_name")).cast("binary").alias("value"))
    return kv.unionByName(tokens)


def _shifted(ts: Column) -> Column:
    return ts + F.expr("INTERVAL '28' YEAR")


def mute_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, check_name, op ('mute'/'unmute'), until (RFC 3339 text or null)."""
    o = table(spark, sf_dir, "orders")
    pri, st, od = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderdate")
    unmute = pri == "1-URGENT"
    # RFC 3339 text of a midnight timestamp: "yyyy-MM-dd" + "T00:00:00" + offset
    day = F.substring(_shifted(od).cast("string"), 1, 10)
    until = (F.when(unmute, F.lit(None))
             .when(st == "F", F.concat(day, F.lit("T00:00:00Z")))
             .when((st == "P") & (pri == "2-HIGH"), F.lit("not-a-date"))
             .when((st == "P") & (pri == "3-MEDIUM"), F.concat(day, F.lit("T00:00:00+02:00"))))
    return o.select(F.col("o_orderkey").alias("seq"),
                    F.concat(F.lit("check-"), _s("o_custkey")).alias("check_name"),
                    F.when(unmute, F.lit("unmute")).otherwise(F.lit("mute")).alias("op"),
                    until.alias("until"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry versions: check_name, version_seq, valid_from, mute, mute_until."""
    o = table(spark, sf_dir, "orders")
    valid_from = F.timestamp_add("SECOND", (F.col("o_orderkey") * 17) % MONTH_SECONDS, _epoch())
    return o.select(F.concat(F.lit("check-"), _s("o_custkey")).alias("check_name"),
                    F.col("o_orderkey").alias("version_seq"),
                    valid_from.alias("valid_from"),
                    F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("mute"),
                    F.when(F.col("o_orderstatus") == "F",
                           _shifted(F.col("o_orderdate"))).alias("mute_until"))


def spec_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry change feed: seq, op, check_name, changed_at and the whole spec."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    passive = F.col("o_orderpriority") == "5-LOW"
    return o.select(key.alias("seq"),
                    F.when(F.col("o_orderstatus") == "P", F.lit("Remove"))
                    .otherwise(F.lit("AddOrUpdate")).alias("op"),
                    F.concat(F.lit("check-"), _s("o_custkey")).alias("check_name"),
                    F.timestamp_add("SECOND", key * CHANGE_STEP_SECONDS, _epoch()).alias("changed_at"),
                    passive.alias("passive"),
                    F.when(passive, F.lit(None)).otherwise(60 * (1 + key % 10))
                    .cast("bigint").alias("check_interval"),
                    F.when(~passive, F.concat(F.lit("script-"), _s(key % 30))).alias("script_ref"),
                    F.when(F.col("o_orderpriority") != "3-MEDIUM", F.array(
                        F.concat(F.lit("secret-"), _s(key % 6)),
                        F.concat(F.lit("secret-"), _s(F.col("o_custkey") % 9)))).alias("secret_refs"),
                    F.when(key % 4 != 0, F.array(F.concat(F.lit("channel-"), _s(key % 8))))
                    .otherwise(F.array().cast("array<string>")).alias("channel_refs"),
                    (F.col("o_orderpriority") == "2-HIGH").alias("mute"),
                    F.when(F.col("o_orderstatus") == "F", _shifted(F.col("o_orderdate"))).alias("mute_until"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """submission_id, received_at, check_name, output, status (int), image_jpg_base64."""
    eid = F.col("event_id")
    image = (F.when(eid % 5 == 0, F.base64(F.col("props").cast("binary")))
             .when(eid % 17 == 0, F.lit("not*base64")))
    return (table(spark, sf_dir, "events")
            .select(*_result_columns(), image.alias("image_jpg_base64"))
            .select(F.col("event_id").alias("submission_id"), F.col("ts").alias("received_at"),
                    "check_name", "output", F.col("status_code").alias("status"),
                    "image_jpg_base64"))


REPLAY_OFFSET = 1_000_000_000


def results_with_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results plus an earlier-arriving replay of every Warning result.

    A replay has the same (check_name, ts), arrives first and repeats the
    metric key ``k`` — so it wins result de-duplication and carries a
    duplicate metric key. Columns: arrival, event_id, ts, check_name,
    status_code, output.
    """
    r = results(spark, sf_dir).withColumn("arrival", F.col("event_id"))
    replays = (r.filter(F.col("status_code") == 1)
               .withColumn("arrival", F.col("event_id") - REPLAY_OFFSET)
               .withColumn("output", F.concat(F.col("output"), F.lit(",k=0"))))
    return r.unionByName(replays)


def result_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result stream: msg_id, payload (JSON). Some records are broken:
    truncated JSON, a missing ``output``, a numeric ``check_name``, a numeric
    ``chat_id`` and a boolean ``bot_token``."""
    from vigil.functions.status import code_to_status
    from vigil.operators.decode import encode_result
    e = table(spark, sf_dir, "events").select(*_result_columns(), "user_id")
    eid, uid = F.col("event_id"), F.col("user_id")
    name = code_to_status(F.col("status_code"))
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    chans = F.when(uid % 2 == 0, F.array(F.struct(
        F.concat(F.lit("-100"), _s(uid % 10)).alias("chat_id"), F.lit("tok").alias("bot_token")))
    ).otherwise(F.array().cast("array<struct<chat_id:string,bot_token:string>>"))
    good = encode_result(F.col("check_name"), F.col("output"), name, F.col("ts"), chans,
                         F.lit(None).cast("boolean"), F.lit(None).cast("timestamp_ntz"))
    no_output = F.to_json(F.struct(F.col("check_name"), name.alias("status"),
                                   F.date_format("ts", fmt).alias("timestamp"),
                                   chans.alias("telegram_channels")))
    numeric_name = F.to_json(F.struct(uid.alias("check_name"), F.col("output"), name.alias("status"),
                                      F.date_format("ts", fmt).alias("timestamp"),
                                      chans.alias("telegram_channels")))
    loose = [F.to_json(F.struct(F.col("check_name"), F.col("output"), name.alias("status"),
                                F.array(F.struct(chat.alias("chat_id"), token.alias("bot_token")))
                                .alias("telegram_channels")))
             for chat, token in ((F.lit(5), F.lit("tok")), (F.lit("-1"), F.lit(True)))]
    payload = (F.when(eid % 23 == 0, F.expr("substring(payload_good, 1, length(payload_good) - 5)"))
               .when(eid % 29 == 0, no_output).when(eid % 31 == 0, numeric_name)
               .when(eid % 41 == 0, loose[0]).when(eid % 43 == 0, loose[1])
               .otherwise(F.col("payload_good")))
    return (e.withColumn("payload_good", good)
            .select(eid.alias("msg_id"), payload.alias("payload")))


def redelivered_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result stream with some messages delivered twice under one id."""
    p = result_payloads(spark, sf_dir)
    return p.unionByName(p.filter(F.col("msg_id") % 37 == 0))
