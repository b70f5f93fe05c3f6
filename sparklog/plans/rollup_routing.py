"""Summaries over a time range: whole hours from the rollup, the two edges from the rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.functions.times import to_ns
from sparklog.operators.summary import group_column
from sparklog.plans.pruning import between
from sparklog.schema import NS_PER_DAY, NS_PER_HOUR

GROUPABLE = ("service", "severity")
_EPOCH_DAY = dt.date(1970, 1, 1)


def _day(ns: int) -> dt.date:
    return _EPOCH_DAY + dt.timedelta(days=ns // NS_PER_DAY)


def summary_from_rollup(
    rollup: DataFrame,
    raw: DataFrame,
    since: int | str | None = None,
    until: int | str | None = None,
    group_by: tuple[str, ...] = GROUPABLE,
    now_ns: int | None = None,
) -> DataFrame:
    """The same result as ``summary`` on the raw rows, reading at most two hours of them."""
    if not set(group_by) <= set(GROUPABLE):
        raise ValueError(f"the rollup keeps {GROUPABLE}, not {group_by}")
    start, end = to_ns(since, now_ns), to_ns(until, now_ns)
    first = None if start is None else -(-start // NS_PER_HOUR) * NS_PER_HOUR
    last = None if end is None else end // NS_PER_HOUR * NS_PER_HOUR
    columns = ["service", "severity", "count"]

    def edge(a: int | None, b: int | None) -> DataFrame:
        return between(raw, a, b).select("service", "severity", F.lit(1).cast("bigint").alias("count"))

    if first is not None and last is not None and first >= last:
        parts = [edge(start, end)]
    else:
        whole = rollup
        if first is not None:
            whole = whole.where(F.col("hour_ns") >= first)
            if "day" in rollup.columns:
                whole = whole.where(F.col("day") >= F.lit(_day(first)))
        if last is not None:
            whole = whole.where(F.col("hour_ns") < last)
            if "day" in rollup.columns:
                whole = whole.where(F.col("day") <= F.lit(_day(last - 1)))
        parts = [whole.select(*columns)]
        if start != first:
            parts.append(edge(start, first))
        if end != last:
            parts.append(edge(last, end))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*[group_column(name) for name in group_by]).agg(F.sum("count").alias("count"))
