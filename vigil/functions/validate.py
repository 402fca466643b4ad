"""Strict decoders: RFC 3339 time, base64 image, UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3339 date-time (date, time, optional fraction of any length,
# offset up to 23:59, second 60) and canonical padded base64 with zero trailing bits.
RFC3339 = (r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}):([0-5][0-9]|60)"
           r"(?:\.([0-9]++))?(?:[Zz]|([+-])([01][0-9]|2[0-3]):([0-5][0-9]))\z")
BASE64 = (r"^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?\z")


def parse_rfc3339(text: Column) -> Column:
    """RFC 3339 text -> TIMESTAMP_NTZ in UTC (µs; finer digits truncate).

    Null when the text is not RFC 3339 or names an impossible date or time.
    Second 60 is the instant after second 59. The parts are added to a zone-less
    time, so the session time zone plays no part.

    The grammar is tested once; what passes has its parts in fixed places, so they
    are cut out without a regular expression.
    """
    cut = lambda start, size: F.substring(text, start, size)
    # The zone is one letter or six characters; the fraction is what lies before it.
    zone = F.when(cut(-1, 1).isin("Z", "z"), F.lit(1)).otherwise(F.lit(6))
    digits = text.substr(F.lit(21), F.greatest(F.lit(0), F.least(F.lit(6), F.length(text) - F.lit(20) - zone)))
    leap = cut(18, 2) == "60"
    base = F.concat(cut(1, 10), F.lit(" "), cut(12, 6), F.when(leap, F.lit("59")).otherwise(cut(18, 2))).try_cast("timestamp_ntz")
    micros = F.rpad(digits, 6, "0").try_cast("bigint")
    minutes = F.when(zone == 1, F.lit(0)).otherwise(cut(-5, 2).try_cast("bigint") * 60 + cut(-2, 2).try_cast("bigint"))
    shift = F.when(cut(-6, 1) == "-", minutes).otherwise(-minutes) * 60_000_000
    leap_micros = F.when(leap, F.lit(1_000_000)).otherwise(F.lit(0))
    return F.when(text.rlike(RFC3339), F.timestamp_add("MICROSECOND", shift + leap_micros + micros, base))


def is_strict_base64(text: Column) -> Column:
    return text.rlike(BASE64)


def decode_base64(text: Column) -> Column:
    """Bytes of strict base64 text, null when invalid."""
    return F.when(is_strict_base64(text), F.unbase64(text))


def strict_utf8(b: Column) -> Column:
    """Binary -> string, null when not valid UTF-8."""
    return F.try_validate_utf8(b.cast("string"))


def lossy_utf8(b: Column) -> Column:
    return F.make_valid_utf8(b.cast("string"))
