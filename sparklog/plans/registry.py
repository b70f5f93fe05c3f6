"""Registered queries: a Spark job over the shared tables and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.functions.ids import hex_id
from sparklog.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that must give the same rows."""

    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(configure(spark), sf_dir)

        name = query.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def shown(df: DataFrame) -> DataFrame:
    """The columns query results are compared on; ids as hex text."""
    return df.select(
        "record_id",
        "time_ns",
        "severity",
        "service",
        "instance",
        "logger",
        hex_id(F.col("trace_id")).alias("trace"),
        "message",
        "attrs_json",
    )


# SQL text of the same views of the shared tables.
SQL_SEVERITY = """CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9
       WHEN 'click' THEN 5 ELSE 1 END"""
SQL_LOGS = f"""logs AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS record_id, epoch_us(ts) * 1000 AS time_ns,
    epoch_us(ts) * 1000 + (event_id % 1000) * 1000000000 AS ingest_ns,
    {SQL_SEVERITY} AS severity,
    'app-' || event_type AS service, 'host-' || CAST(user_id % 10 AS VARCHAR) AS instance,
    'events.' || event_type AS logger, md5(CAST(user_id AS VARCHAR)) AS trace,
    event_type || ' by user ' || CAST(user_id AS VARCHAR) AS message, props AS attrs_json,
    CAST(ts AS DATE) AS day, user_id, event_id, ts
  FROM events)"""
SQL_DOCS = """docs AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS record_id, (1704067200 + doc_id) * 1000000000 AS time_ns,
    doc_id, text AS message, source AS service, lang
  FROM documents)"""
SQL_SHOWN = "record_id, time_ns, severity, service, instance, logger, trace, message, attrs_json"
SQL_LABEL = """CASE WHEN severity >= 21 THEN 'FATAL' WHEN severity >= 17 THEN 'ERROR' WHEN severity >= 13 THEN 'WARN'
    WHEN severity >= 9 THEN 'INFO' WHEN severity >= 5 THEN 'DEBUG' WHEN severity >= 1 THEN 'TRACE'
    ELSE 'UNSPECIFIED' END"""


def sql_rfc3339(ns: str) -> str:
    return (
        f"strftime(make_timestamp({ns} // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {ns} % 1000000000 = 0 THEN '' "
        f"ELSE '.' || rtrim(lpad(CAST({ns} % 1000000000 AS VARCHAR), 9, '0'), '0') END || 'Z'"
    )


def from_logs(body: str) -> str:
    return f"WITH {SQL_LOGS} {body}"


def from_docs(body: str) -> str:
    return f"WITH {SQL_DOCS} {body}"
