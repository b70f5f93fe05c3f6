"""Time bounds that reach the scan.

Catalyst does not know that ``day`` follows from ``time_ns``, so a time range also gets
the bounds it implies on the partition column, and on ``ts`` where a source has one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.schema import NS_PER_DAY

_EPOCH = dt.datetime(1970, 1, 1)


def date_of(ns: int) -> dt.date:
    return _EPOCH.date() + dt.timedelta(days=ns // NS_PER_DAY)


def _micros(ns: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(microseconds=ns // 1000)


def time_bounds(df: DataFrame, since: int | None, until: int | None) -> list[Column]:
    """Clauses for the half-open range [since, until) in nanoseconds; None is open."""
    clauses = []
    types = {field.name: field.dataType for field in df.schema.fields}
    has_ts = isinstance(types.get("ts"), T.TimestampNTZType)
    if since is not None:
        clauses.append(F.col("time_ns") >= since)
        if "day" in types:
            clauses.append(F.col("day") >= F.lit(date_of(since)))
        if has_ts:
            clauses.append(F.col("ts") >= F.lit(_micros(since)).cast("timestamp_ntz"))
    if until is not None:
        clauses.append(F.col("time_ns") < until)
        if "day" in types:
            clauses.append(F.col("day") <= F.lit(date_of(until - 1)))
        if has_ts:
            clauses.append(F.col("ts") <= F.lit(_micros(until - 1)).cast("timestamp_ntz"))
    return clauses


def between(df: DataFrame, since: int | None, until: int | None) -> DataFrame:
    for clause in time_bounds(df, since, until):
        df = df.where(clause)
    return df
