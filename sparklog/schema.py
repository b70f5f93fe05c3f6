"""The one record schema every operator reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

EXCEPTION_TYPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("stacktrace", T.StringType()),
    ]
)

# Times are LONG nanoseconds: a Spark TIMESTAMP stops at microseconds.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType(), False),
        T.StructField("time_ns", T.LongType(), False),
        T.StructField("ingest_ns", T.LongType(), False),
        T.StructField("severity", T.IntegerType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("instance", T.StringType(), False),
        T.StructField("version", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("trace_id", T.BinaryType()),
        T.StructField("span_id", T.BinaryType()),
        T.StructField("message", T.StringType(), False),
        T.StructField("attrs_json", T.StringType()),
        T.StructField("exception", EXCEPTION_TYPE),
        T.StructField("day", T.DateType(), False),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# OpenTelemetry severity floors, and the label each range carries.
SEVERITY_FLOORS = {
    "TRACE": 1,
    "DEBUG": 5,
    "INFO": 9,
    "WARN": 13,
    "ERROR": 17,
    "FATAL": 21,
}
UNSPECIFIED = "UNSPECIFIED"

# Reserved attribute keys.
SERVICE_NAME = "service.name"
SERVICE_VERSION = "service.version"
SERVICE_INSTANCE = "service.instance.id"
CODE_NAMESPACE = "code.namespace"
EXCEPTION_KEYS = {
    "type": "exception.type",
    "message": "exception.message",
    "stacktrace": "exception.stacktrace",
}

# Limits.
NS_PER_SECOND = 1_000_000_000
NS_PER_HOUR = 3600 * NS_PER_SECOND
NS_PER_DAY = 24 * NS_PER_HOUR
MAX_RECORD_AGE_NS = NS_PER_DAY
MAX_BATCH_BYTES = 4 * 1024 * 1024
MAX_RECORD_BYTES = 64 * 1024
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
DEFAULT_ERRORS_LIMIT = 50
COUNT_CAP = 10_000
PREVIEW_CHARS = 200
RETENTION_DAYS = 7
DISK_GUARD_BYTES = 2 * 1024**3
RATE_LIMIT_PER_MINUTE = 10_000
CLOCK_SKEW_NS = 5 * 60 * NS_PER_SECOND
THROTTLE_GAP_NS = 60 * NS_PER_SECOND
