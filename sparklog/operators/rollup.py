"""Hourly counts kept beside the log table, and summaries that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.functions.times import floor_div, utc_day
from sparklog.schema import NS_PER_HOUR


def hourly_rollup(df: DataFrame) -> DataFrame:
    """One row per hour, service and severity."""
    hour = (floor_div(F.col("time_ns"), NS_PER_HOUR) * NS_PER_HOUR).alias("hour_ns")
    return df.groupBy(hour, "service", "severity").agg(F.count("*").alias("count"))


def write_rollup(df: DataFrame, path: str) -> None:
    """Write the rollup of the days in ``df``; other days stay as they are."""
    (
        hourly_rollup(df)
        .withColumn("day", utc_day(F.col("hour_ns")))
        .hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
