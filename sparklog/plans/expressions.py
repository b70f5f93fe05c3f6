"""Registered queries: the scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.functions import ids, severity, text, times
from sparklog.operators import safety
from sparklog.operators.query import attribute
from sparklog.plans.registry import SQL_LABEL, from_logs, registered, sql_rfc3339
from sparklog.sources.driver_tables import logs_from_documents, logs_from_events, table


@registered(f"WITH p AS (SELECT p_partkey, p_size - 10 AS severity FROM part) SELECT p_partkey, {SQL_LABEL} AS label FROM p")
def severity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", severity.severity_label(F.col("p_size") - 10).alias("label")
    )


_SPELLINGS = ["ERROR", "error", "Error", "WARNING", "warning", "warn", "", "invalid", "INFO", "trace", "Fatal", "fatal"]
_FLOORS = [17, 17, 0, 13, 13, 13, 0, 0, 9, 1, 0, 21]
_SQL_LIST = "[" + ", ".join(f"'{s}'" for s in _SPELLINGS) + "]"


def _spelled(column: str):
    return F.get(F.array(*[F.lit(s) for s in _SPELLINGS]), (F.col(column) % len(_SPELLINGS)).cast("int"))


@registered(f"SELECT event_id, CAST({_FLOORS}[event_id % {len(_FLOORS)} + 1] AS INTEGER) AS severity FROM events")
def severity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", severity.severity_from_label(_spelled("event_id")).alias("severity"))


@registered(
    f"""SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN user_id ELSE {_FLOORS}[event_id % {len(_FLOORS)} + 1] END
    AS INTEGER) AS severity FROM events"""
)
def severity_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(_spelled("event_id"))
    return table(spark, sf_dir, "events").select("event_id", severity.read_severity(written).alias("severity"))


@registered(
    f"""WITH t AS (SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ns FROM events)
    SELECT event_id, {sql_rfc3339('ns')} AS time FROM t"""
)
def rfc3339_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_from_events(spark, sf_dir)
    ns = F.col("time_ns") + F.col("record_id").cast("bigint") % 1000
    return logs.select(F.col("record_id").cast("bigint").alias("event_id"), times.rfc3339_nano(ns).alias("time"))


@registered(
    "SELECT CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS records FROM events GROUP BY 1"
)
def utc_day_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = times.utc_day(F.col("time_ns") - 5 * 3_600_000_000_000)
    days = logs_from_events(spark, sf_dir).select(shifted.cast("string").alias("day"))
    return days.groupBy("day").agg(F.count("*").alias("records"))


@registered(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN md5(CAST(user_id AS VARCHAR)) END AS trace,
    CASE WHEN event_id % 3 = 1 THEN left(md5(CAST(user_id AS VARCHAR)), 16) END AS span FROM events"""
)
def id_hex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.md5(F.col("user_id").cast("string"))
    sent = (
        F.when(F.col("event_id") % 3 == 0, F.upper(full))
        .when(F.col("event_id") % 3 == 1, F.left(full, F.lit(16)))
        .otherwise(F.concat(F.lit("zz"), F.substring(full, 3, 30)))
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        ids.hex_id(ids.parse_hex_id(sent, ids.TRACE_BYTES)).alias("trace"),
        ids.hex_id(ids.parse_hex_id(sent, ids.SPAN_BYTES)).alias("span"),
    )


@registered("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def message_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_documents(spark, sf_dir).select("doc_id", text.preview(F.col("message")).alias("preview"))


@registered("SELECT doc_id, text AS message FROM documents")
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    colored = F.concat(
        F.lit("\x1b[1;31m"), F.regexp_replace("message", "\n", "\x1b[0m\n\x1b[32m"), F.lit("\x1b[0m\x1b[K")
    )
    logs = logs_from_documents(spark, sf_dir).withColumn("message", colored)
    return safety.strip_escapes(logs).select("doc_id", "message")


def _sql_redact(column: str) -> str:
    sql = column
    for pattern, replacement in text.SECRET_PATTERNS:
        quoted = pattern.replace("'", "''")
        sql = f"regexp_replace({sql}, '{quoted}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    return sql


@registered(f"SELECT doc_id, {_sql_redact('text')} AS message FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.redact_secrets(logs_from_documents(spark, sf_dir)).select("doc_id", "message")


@registered(f"SELECT page_id, {_sql_redact('url')} AS url FROM pages")
def redact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.redact(F.col("url")).alias("url"))


@registered(
    from_logs("""SELECT record_id, CAST(attrs_json AS JSON)->>'k' AS k, CAST(service AS VARCHAR) AS service FROM logs""")
)
def attrs_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(spark, sf_dir).select("record_id", attribute("k").alias("k"), "service")
