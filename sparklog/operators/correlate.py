"""All rows of one or many traces, across services, in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.operators.query import Bound, filter_logs


def correlate(
    df: DataFrame, traces: str | list[str] | DataFrame, since: Bound = None, until: Bound = None
) -> DataFrame:
    """Rows of the given traces (hex text, or a DataFrame with a binary ``trace_id``).

    The semi-join carries no broadcast hint: Spark broadcasts the ids only when their size is
    under its threshold, and otherwise shuffles with skew splitting. The sort ranges over
    (trace, time, record), so a trace with very many rows spreads over several tasks.
    """
    rows = filter_logs(df, since=since, until=until)
    if isinstance(traces, DataFrame):
        hits = rows.join(traces.select("trace_id"), "trace_id", "left_semi")
    else:
        ids = [traces] if isinstance(traces, str) else traces
        hits = rows.where(F.col("trace_id").isin([F.lit(bytes.fromhex(i)) for i in ids]))
    return hits.orderBy("trace_id", "time_ns", "record_id")
