"""Record schemas and fixed values of the check-result data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the monitored system's encodings).
# Status names in code order: 0 Ok, 1 Warning, 2 Critical, 3 CheckError,
# 4 Pending. Any other code is CheckError.
STATUS_NAMES = ["Ok", "Warning", "Critical", "CheckError", "Pending"]
# Script languages accepted by the declared schema, and their labels.
SCRIPT_LANGUAGES = {"Python": "python", "Bash": "bash"}
# Text of the status row of a check that never produced a result.
PENDING_TEXT = "Check still needs to be executed"
# Secret key holding a channel's bot token.
BOT_TOKEN_KEY = "botToken"
# Retention and time-chunk length of both result tables: 7 days.
RETENTION_SECONDS = 7 * 24 * 3600
CHUNK_SECONDS = 7 * 24 * 3600
# ---------------------------------------------------------------------------

# A channel as tasks carry it: its name stands in for the bot token.
CHANNEL = T.StructType([
    T.StructField("chat_id", T.StringType()),
    T.StructField("channel_name", T.StringType()),
])

SCRIPT = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("python_requirements", T.ArrayType(T.StringType())),
])

# Resolved check as carried on the task stream; secrets travel by name only.
TASK_MESSAGE = T.StructType([
    T.StructField("passive", T.BooleanType()),
    T.StructField("script", SCRIPT),
    T.StructField("interval", T.LongType()),
    T.StructField("check_name", T.StringType()),
    T.StructField("secret_refs", T.ArrayType(T.StringType())),
    T.StructField("telegram_channels", T.ArrayType(CHANNEL)),
    T.StructField("mute_notifications", T.BooleanType()),
    T.StructField("mute_notifications_until", T.StringType()),
])

# Stored tables (event_date is the partition column).
CHECK_RESULT = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("check_name", T.StringType(), False),
    T.StructField("status", T.ShortType(), False),
    T.StructField("output", T.StringType(), False),
    T.StructField("event_date", T.DateType(), False),
])

CHECK_RESULT_PERF = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("check_name", T.StringType(), False),
    T.StructField("perf_key", T.StringType(), False),
    T.StructField("perf_value", T.FloatType(), False),
    T.StructField("event_date", T.DateType(), False),
])

CHECK_SPEC = T.StructType([
    T.StructField("check_name", T.StringType()),
    T.StructField("passive", T.BooleanType()),
    T.StructField("script_ref", T.StringType()),
    T.StructField("check_interval", T.LongType()),
    T.StructField("secret_refs", T.ArrayType(T.StringType())),
    T.StructField("channel_refs", T.ArrayType(T.StringType())),
    T.StructField("mute", T.BooleanType()),
    T.StructField("mute_until", T.TimestampNTZType()),
])

REGISTRY_CHANGE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("check_name", T.StringType()),
    T.StructField("changed_at", T.TimestampNTZType()),
    *CHECK_SPEC.fields[1:],
])

# Submissions of passive results (A6) and mute commands.
SUBMISSION = T.StructType([
    T.StructField("submission_id", T.LongType()),
    T.StructField("received_at", T.TimestampNTZType()),
    T.StructField("check_name", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("image_jpg_base64", T.StringType()),
])

MUTE_COMMAND = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("check_name", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("until", T.StringType()),
])
