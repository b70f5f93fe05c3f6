"""Filtered newest-first queries over a log DataFrame."""

from __future__ import annotations

import datetime as dt
import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions.ids import hex_id
from sparklog.functions.severity import severity_label, severity_value
from sparklog.functions.times import rfc3339_nano, to_ns
from sparklog.functions.tokens import Match
from sparklog.plans.pruning import time_bounds
from sparklog.schema import DEFAULT_ERRORS_LIMIT, DEFAULT_LIMIT, LOG_COLUMNS, MAX_LIMIT, SEVERITY_FLOORS

Bound = int | str | dt.datetime | None


def attribute(key: str, attrs: str = "attrs_json") -> Column:
    """One attribute as text; the bracket path keeps dotted keys whole."""
    parsed = F.try_parse_json(attrs)
    if "'" not in key and '"' not in key:
        return F.try_variant_get(parsed, f"$['{key}']", "string")
    # A path cannot hold quotes; a map lookup can.
    value = F.try_element_at(parsed.try_cast("map<string, variant>"), F.lit(key))
    return F.try_variant_get(value, "$", "string")


def log_filter(
    df: DataFrame,
    services: list[str] | None = None,
    min_severity: int | str | None = None,
    since: Bound = None,
    until: Bound = None,
    trace_id: str | None = None,
    text: Match | None = None,
    attributes: dict[str, str] | None = None,
    now_ns: int | None = None,
) -> list[Column]:
    """The clauses of a query, cheapest first. An empty list means no filter."""
    clauses = time_bounds(df, to_ns(since, now_ns), to_ns(until, now_ns))
    if services:
        clauses.append(F.col("service").isin(list(services)))
    floor = severity_value(min_severity)
    if floor > 0:
        clauses.append(F.col("severity") >= floor)
    if trace_id:
        clauses.append(F.col("trace_id") == F.lit(bytes.fromhex(trace_id)))
    for key, value in (attributes or {}).items():
        clauses.append(attribute(key) == value)
    if text is not None:
        clauses.append(text.on(F.col("message")))
    return clauses


def filter_logs(df: DataFrame, **filters) -> DataFrame:
    """Rows matching every given filter (see ``log_filter``), unordered and unlimited."""
    clauses = log_filter(df, **filters)
    return df.where(reduce(lambda a, b: a & b, clauses)) if clauses else df


def row_limit(limit: int | None, default: int = DEFAULT_LIMIT) -> int:
    """None or 0 gives the default, anything above the maximum the maximum."""
    if limit is not None and limit < 0:
        raise ValueError(f"limit: must be >= 0, got {limit}")
    return min(limit or default, MAX_LIMIT)


def newest(df: DataFrame, limit: int | None = None, clamp: bool = True) -> DataFrame:
    """Top rows by time, newest first. ``record_id`` settles ties."""
    rows = row_limit(limit) if clamp else limit
    ordered = df.orderBy(F.desc("time_ns"), "record_id")
    return ordered if rows is None else ordered.limit(rows)


def _log_columns(df: DataFrame) -> list[str]:
    return [c for c in LOG_COLUMNS if c in df.columns]


def query_logs(
    df: DataFrame,
    limit: int | None = None,
    after: tuple[int, str] | None = None,
    clamp: bool = True,
    **filters,
) -> DataFrame:
    """Newest matching rows. ``clamp=False`` lifts the row limit for batch use.

    ``after`` is the (time_ns, record_id) of the last row of the page before.
    """
    matching = filter_logs(df, **filters)
    if after is not None:
        stamp, record_id = after
        matching = filter_logs(matching, until=stamp + 1).where(
            (F.col("time_ns") < stamp) | (F.col("record_id") > record_id)
        )
    return newest(matching.select(*_log_columns(matching)), limit, clamp)


def recent_errors(
    df: DataFrame, now_ns: int, window: str = "1h", limit: int | None = None, services: list[str] | None = None
) -> DataFrame:
    """Newest rows at ERROR and above in the window that ends now."""
    return query_logs(
        df,
        services=services,
        min_severity=SEVERITY_FLOORS["ERROR"],
        since=to_ns(window, now_ns),
        limit=limit or DEFAULT_ERRORS_LIMIT,
    )


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row: label, RFC 3339 times, hex ids; empty optional fields left out."""

    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    e = F.col("exception")
    shape = F.struct(
        rfc3339_nano(F.col("time_ns")).alias("time"),
        rfc3339_nano(F.col("ingest_ns")).alias("ingest"),
        severity_label(F.col("severity")).alias("severity"),
        F.col("service"),
        filled("instance").alias("instance"),
        filled("version").alias("version"),
        filled("logger").alias("logger"),
        hex_id(F.col("trace_id")).alias("trace_id"),
        hex_id(F.col("span_id")).alias("span_id"),
        F.col("message"),
        F.try_parse_json("attrs_json").alias("attrs"),
        F.when(
            e.isNotNull(),
            F.struct(*[F.nullif(e[f], F.lit("")).alias(f) for f in ("type", "message", "stacktrace")]),
        ).alias("exception"),
    )
    return df.select("record_id", "time_ns", F.to_json(shape).alias("record"))


def count_capped(df: DataFrame, cap: int = 10_000) -> DataFrame:
    """min(count, cap) in one row, named ``count_total_estimate``.

    A limit before the count would move up to ``cap`` rows of every task into one; partial
    counts move one number per task.
    """
    return df.agg(F.least(F.count("*"), F.lit(cap).cast("bigint")).alias("count_total_estimate"))


def schema_hash(df: DataFrame) -> str:
    return hashlib.md5(df.schema.json().encode()).hexdigest()
