"""Error-rate alerts: windows whose share of ERROR rows reaches a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.functions.times import floor_div
from sparklog.schema import NS_PER_SECOND, SEVERITY_FLOORS


def error_rates(df: DataFrame, window_seconds: int = 300) -> DataFrame:
    width = window_seconds * NS_PER_SECOND
    start = (floor_div(F.col("time_ns"), width) * width).alias("window_ns")
    return df.groupBy(start, "service").agg(
        F.count_if(F.col("severity") >= SEVERITY_FLOORS["ERROR"]).alias("errors"),
        F.count("*").alias("records"),
    )


def error_rate_alert(
    df: DataFrame, window_seconds: int = 300, threshold: float = 0.1, min_records: int = 1
) -> DataFrame:
    """Windows over the threshold. Compared as errors >= threshold * records, without division."""
    rates = error_rates(df, window_seconds)
    over = F.col("errors") >= F.col("records") * F.lit(threshold)
    return rates.where((F.col("records") >= min_records) & (F.col("errors") > 0) & over)
