"""Queries of a stored table that are planned by its catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.functions.times import to_ns
from sparklog.operators.query import filter_logs, newest, row_limit
from sparklog.plans.pruning import date_of
from sparklog.sources.log_table import partition_days, read_logs


def stored_newest(spark: SparkSession, table: str, limit: int | None = None, now_ns: int | None = None, **filters) -> DataFrame:
    """The newest matching rows of a stored table, as ``query_logs``, reading no more days than needed.

    Rows lie in the day of their time, so days are taken from the newest on, twice as many each time,
    until they hold enough matching rows. With few matches all days are read, the last time at once.
    """
    rows, wanted = read_logs(spark, table), row_limit(limit)
    since, until = to_ns(filters.get("since"), now_ns), to_ns(filters.get("until"), now_ns)
    days = [row.day for row in partition_days(spark, table).collect()]  # one row for each stored day
    days = [d for d in days if (since is None or d >= date_of(since)) and (until is None or d <= date_of(until - 1))]
    matching = filter_logs(rows, now_ns=now_ns, **filters)
    taken = 1
    while taken < len(days):
        some = matching.where(F.col("day") >= F.lit(days[-taken]))
        if some.limit(wanted).count() >= wanted:
            return newest(some, wanted, clamp=False)
        taken *= 2
    return newest(matching, wanted, clamp=False)
