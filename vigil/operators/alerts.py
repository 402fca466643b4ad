"""Alert decision, routing and outbox; submission enrichment; as-of state
(F3, F4, D6, D8, D12, C8-C10, B10, K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import perf, status, text, validate


def alertable_status(status_name: Column) -> Column:
    """every status except Ok and Pending alerts."""
    return ~status_name.isin("Ok", "Pending")


def unmuted(mute: Column, until: Column, as_of: Column) -> Column:
    """muted with no until -> silent; muted until <= as_of -> send;
    mute false / null -> send (until ignored)."""
    return ~F.coalesce(mute, F.lit(False)) | F.coalesce(until <= as_of, F.lit(False))


def should_send(status_name: Column, mute: Column, until: Column, as_of: Column) -> Column:
    return alertable_status(status_name) & unmuted(mute, until, as_of)


def enrich(results: DataFrame, resolved: DataFrame, key: str = "check_name"):
    """Attach the registry's channels and mute state as of receipt.

    Returns (enriched, rejected). No broadcast hint: AQE turns the join into a
    broadcast when the registry side measures small at runtime and otherwise
    splits a skewed check's partition.
    """
    state = resolved.select(key, "channels", "mute", "mute_until")
    return results.join(state, key, "inner"), results.join(state.select(key), key, "left_anti")


def routes(alerts: DataFrame) -> DataFrame:
    """One row per (alert, channel position); no channels -> no rows."""
    return alerts.select("*", F.posexplode("channels").alias("pos", "channel")).drop("channels")


def outbox(routed: DataFrame, ts: str, image: str | None = None) -> DataFrame:
    """K6: message text, kind, attachment and image columns per routed alert.

    An image that is not strict base64 is flagged ``image_error`` and the
    message goes out as text (the result itself is stored either way).
    """
    img = F.col(image) if image else F.lit(None).cast("string")
    decoded = validate.decode_base64(img)
    has_image = decoded.isNotNull()
    return routed.select(
        "*",
        F.col("channel.chat_id").alias("chat_id"),
        text.message_kind(has_image).alias("kind"),
        F.when(has_image, text.attachment_name(F.col("check_name"))).alias("attachment"),
        decoded.alias("image"),
        F.length(decoded).cast("bigint").alias("image_size"),
        (img.isNotNull() & ~has_image).alias("image_error"),
        text.alert_message(F.col(ts), F.col("check_name"), F.col("status_name"),
                           perf.display_text(F.col("output"))).alias("message"))


def with_status_name(df: DataFrame, code: str) -> DataFrame:
    return df.withColumn("status_name", status.code_to_status(F.col(code)))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              right_seq: str, right_cols: list[str], unit: str = "hour") -> DataFrame:
    """For every left row, the right row of the same key with the latest
    ``right_ts <= left_ts`` (ties: larger ``right_seq``). Columns of that right
    row are added (null when none).

    Skew-aware: the ordered window is partitioned by (key, time bucket), and
    the last right row of earlier buckets is carried in by a second window
    over one row per (key, bucket). No group ever holds a key's whole history
    and no pairs are produced.
    """
    bucket = lambda c: F.date_trunc(unit, c)
    payload = F.struct(*[F.col(c) for c in right_cols])
    r = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"),
                     F.col(right_seq).alias("_seq"), payload.alias("_v"))
    r = r.withColumn("_b", bucket(F.col("_t")))
    l_cols = left.columns
    lft = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"),
                      F.struct(*[F.col(c) for c in l_cols]).alias("_l"))
    lft = lft.withColumn("_b", bucket(F.col("_t")))

    # carry-in: last right row of every earlier bucket, per (key, left bucket)
    last_in_bucket = (r.groupBy("_k", "_b")
                      .agg(F.max(F.struct("_t", "_seq", "_v")).alias("_m"))
                      .select("_k", "_b", F.lit(1).alias("_o"), "_m"))
    left_buckets = lft.select("_k", "_b").distinct().select(
        "_k", "_b", F.lit(0).alias("_o"), F.lit(None).cast(last_in_bucket.schema["_m"].dataType).alias("_m"))
    w_carry = (Window.partitionBy("_k").orderBy("_b", "_o")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = (left_buckets.unionByName(last_in_bucket)
             .withColumn("_c", F.last("_m", ignorenulls=True).over(w_carry))
             .filter(F.col("_o") == 0)
             .select("_k", "_b", F.col("_c._v").alias("_v"), F.col("_c._seq").alias("_seq")))

    null_l = F.lit(None).cast(lft.schema["_l"].dataType)
    rows = (carry.select("_k", "_b", F.lit(None).cast(r.schema["_t"].dataType).alias("_t"),
                         F.lit(-1).alias("_src"), "_seq", "_v", null_l.alias("_l"))
            .unionByName(r.select("_k", "_b", "_t", F.lit(0).alias("_src"), "_seq", "_v",
                                  null_l.alias("_l")))
            .unionByName(lft.select("_k", "_b", "_t", F.lit(1).alias("_src"),
                                    F.lit(None).cast(r.schema["_seq"].dataType).alias("_seq"),
                                    F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), "_l")))
    w = (Window.partitionBy("_k", "_b").orderBy("_t", "_src", "_seq")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (rows.withColumn("_asof", F.last("_v", ignorenulls=True).over(w))
           .filter(F.col("_src") == 1))
    return out.select(*[F.col(f"_l.{c}").alias(c) for c in l_cols],
                      *[F.col(f"_asof.{c}").alias(c) for c in right_cols])
