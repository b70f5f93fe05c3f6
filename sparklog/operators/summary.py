"""Counts, listings and introspection. Every one is a partial-then-final aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions.severity import severity_label
from sparklog.functions.times import floor_div, rfc3339_nano
from sparklog.operators.query import Bound, attribute, filter_logs
from sparklog.schema import CLOCK_SKEW_NS, NS_PER_HOUR, NS_PER_SECOND, RETENTION_DAYS, SEVERITY_FLOORS

_ERROR = SEVERITY_FLOORS["ERROR"]
_PAIR = "struct<field: string, value: string>"


def distinct_services(df: DataFrame) -> DataFrame:
    return df.select("service").distinct().orderBy("service")


def distinct_services_across(frames: list[DataFrame]) -> DataFrame:
    """Services over separate tables, each made distinct before the union."""
    parts = [frame.select("service").distinct() for frame in frames]
    return reduce(DataFrame.union, parts).distinct().orderBy("service")


def union_logs(frames: list[DataFrame]) -> DataFrame:
    """Rows of separate tables; columns an older table lacks come back NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def partition_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("day").alias("partitions"))


def group_column(name: str) -> Column:
    """A column, the severity label for ``severity``, or an attribute for ``attr.<key>``."""
    if name == "severity":
        return severity_label(F.col("severity")).alias("severity")
    if name.startswith("attr."):
        return attribute(name[len("attr.") :]).alias(name)
    return F.col(name)


def summary(
    df: DataFrame,
    group_by: tuple[str, ...] = ("service", "severity"),
    since: Bound = None,
    until: Bound = None,
    now_ns: int | None = None,
) -> DataFrame:
    """Row counts per group in a window; groups without rows do not appear."""
    rows = filter_logs(df, since=since, until=until, now_ns=now_ns)
    return rows.groupBy(*[group_column(name) for name in group_by]).agg(F.count("*").alias("count"))


def overview(df: DataFrame, now_ns: int) -> DataFrame:
    """One row per service, with the errors of the last hour."""
    recent = (F.col("time_ns") >= now_ns - NS_PER_HOUR) & (F.col("time_ns") < now_ns)
    return df.groupBy("service").agg(
        F.count("*").alias("records"),
        F.count_if((F.col("severity") >= _ERROR) & recent).alias("last_hour_errors"),
        F.max("time_ns").alias("newest_ns"),
    )


def attribute_keys(df: DataFrame) -> DataFrame:
    keys = F.explode(F.json_object_keys("attrs_json")).alias("attribute_key")
    return df.where(F.col("attrs_json").isNotNull()).select(keys).distinct()


def bounds(df: DataFrame, retention_days: int = RETENTION_DAYS) -> DataFrame:
    return df.agg(
        rfc3339_nano(F.min("time_ns")).alias("oldest_record_ts"),
        rfc3339_nano(F.max("time_ns")).alias("newest_record_ts"),
        F.lit(retention_days).alias("retention_days"),
    )


def introspect(df: DataFrame) -> DataFrame:
    """(field, value) rows: every service, logger, severity label and attribute key in use.

    Long form, so no list grows inside one row; one scan feeds all four.
    """
    keys = F.coalesce(F.json_object_keys("attrs_json"), F.array().cast("array<string>"))

    def pair(field: str, value: Column) -> Column:
        return F.named_struct(F.lit("field"), F.lit(field), F.lit("value"), value).cast(_PAIR)

    single = F.array(
        pair("service", F.col("service")),
        pair("logger", F.col("logger")),
        pair("severity", severity_label(F.col("severity"))),
    )
    found = F.concat(single, F.transform(keys, lambda key: pair("attribute_key", key)))
    return df.select(F.inline(found)).where(F.col("value").isNotNull()).distinct()


def partition_info(df: DataFrame) -> DataFrame:
    """Per day: rows, first and last ingest."""
    return df.groupBy("day").agg(
        F.count("*").alias("row_count"),
        F.min("ingest_ns").alias("first_ingest_ns"),
        F.max("ingest_ns").alias("last_ingest_ns"),
    )


def ingest_rate(df: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Rows and rows per second in each time bucket."""
    width = bucket_seconds * NS_PER_SECOND
    bucket = (floor_div(F.col("time_ns"), width) * width).alias("bucket_ns")
    return df.groupBy(bucket).agg(
        F.count("*").alias("rows"),
        F.round(F.count("*") / bucket_seconds, 6).alias("rows_per_second"),
    )


def clock_skew(df: DataFrame, limit_ns: int = CLOCK_SKEW_NS) -> DataFrame:
    """Per service: rows whose own time and ingest time differ by more than the limit."""
    behind = F.col("time_ns") < F.col("ingest_ns") - limit_ns
    ahead = F.col("ingest_ns") < F.col("time_ns") - limit_ns
    return (
        df.groupBy("service")
        .agg(F.count("*").alias("records"), F.count_if(behind).alias("behind"), F.count_if(ahead).alias("ahead"))
        .where((F.col("behind") > 0) | (F.col("ahead") > 0))
    )
