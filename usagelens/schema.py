"""Declared schemas of the raw envelope, the event table and the employee table."""

from pyspark.sql import types as T

_TEXT, _LONG, _REAL = T.StringType(), T.LongType(), T.DoubleType()

# One line of a raw log. Events are maps so that a missing key and an explicit
# null stay distinguishable.
ENVELOPE = T.StructType(
    [
        T.StructField("messageType", _TEXT),
        T.StructField("logEvents", T.ArrayType(T.MapType(_TEXT, _TEXT))),
        T.StructField("_corrupt", _TEXT),
    ]
)

# Event columns in stored order. event_ts and event_date are derived from
# event_timestamp; ingested_at is stamped by the load.
EVENTS = T.StructType(
    [
        T.StructField("id", _TEXT),
        T.StructField("timestamp", _LONG),
        T.StructField("event_timestamp", _TEXT),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("event_name", _TEXT),
        T.StructField("organization_id", _TEXT),
        T.StructField("session_id", _TEXT),
        T.StructField("user_id", _TEXT),
        T.StructField("user_email", _TEXT),
        T.StructField("user_practice", _TEXT),
        T.StructField("user_profile", _TEXT),
        T.StructField("terminal_type", _TEXT),
        T.StructField("model", _TEXT),
        T.StructField("input_tokens", _LONG),
        T.StructField("output_tokens", _LONG),
        T.StructField("cache_creation_tokens", _LONG),
        T.StructField("cache_read_tokens", _LONG),
        T.StructField("cost_usd", _REAL),
        T.StructField("duration_ms", _LONG),
        T.StructField("prompt_length", _LONG),
        T.StructField("tool_name", _TEXT),
        T.StructField("decision", _TEXT),
        T.StructField("decision_source", _TEXT),
        T.StructField("success", _TEXT),
        T.StructField("host_name", _TEXT),
        T.StructField("os_type", _TEXT),
        T.StructField("service_version", _TEXT),
        T.StructField("raw_message", _TEXT),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

# Columns an event line provides (everything but the load-time stamp).
PARSED_COLUMNS = [name for name in EVENTS.names if name != "ingested_at"]

# What the stored table has besides: the load of a row and the folders that hold it.
PARTITIONS = T.StructType(
    [
        T.StructField("load_id", _TEXT),
        T.StructField("event_name", _TEXT),
        T.StructField("event_date", T.DateType()),
        T.StructField("part", _TEXT),
    ]
)

EMPLOYEES = T.StructType(
    [T.StructField(n, _TEXT) for n in ("email", "full_name", "practice", "level", "location")]
)
