"""Hourly counts and error rates over a stream, in event time.

Every micro-batch writes its own counts under the identity of its query, which stays with the
checkpoint, and its number. Readers add them up. There is no watermark on client time and no state, so a
fast clock never makes later rows vanish, and late rows still count.

Now and then the counts so far are merged into one generation. Its manifest says up to which number of each
query it holds the counts, and readers go by the newest manifest; so neither a replay nor a
crash while merging changes a sum, and the files are bounded by those of one generation and ``merge_every`` updates.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sparklog.functions.times import floor_div
from sparklog.schema import NS_PER_HOUR, NS_PER_SECOND, SEVERITY_FLOORS
from sparklog.session import remove_path

MERGE_EVERY = 100


def hourly_counts(logs: DataFrame) -> DataFrame:
    """Counts per hour, service and severity."""
    hour_ns = (floor_div(F.col("time_ns"), NS_PER_HOUR) * NS_PER_HOUR).alias("hour_ns")
    return logs.groupBy(hour_ns, "service", "severity").agg(F.count("*").alias("count"))


def error_counts(logs: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Records and ERROR rows of each service and window."""
    width = window_seconds * NS_PER_SECOND
    window_ns = (floor_div(F.col("time_ns"), width) * width).alias("window_ns")
    errors = F.count_if(F.col("severity") >= SEVERITY_FLOORS["ERROR"]).alias("errors")
    return logs.groupBy(window_ns, "service").agg(errors, F.count("*").alias("records"))


def over_rate(counts: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Windows of a service whose share of ERROR rows reaches the threshold."""
    return counts.where((F.col("errors") > 0) & (F.col("errors") >= F.col("records") * F.lit(threshold)))


def write_counts(
    stream: DataFrame,
    count: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = True,
    keys: list[str] | None = None,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Write the counts of each micro-batch to a folder of its own, so that a replay changes nothing.

    Several queries may write to one path. With ``keys``, the grouping columns of the counts, this one
    merges all counts after every ``merge_every`` of its micro-batches; let one query do so.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        counts = count(batch)
        counts.write.mode("overwrite").parquet(os.path.join(_deltas(path), f"query={own}", f"update={number}"))
        if keys and (number + 1) % merge_every == 0:
            merge_counts(batch.sparkSession, path, keys, [c for c in counts.columns if c not in keys])

    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _deltas(path: str) -> str:
    return os.path.join(path, "deltas")


def _merged(path: str, generation: int) -> str:
    return os.path.join(path, "merged", f"generation={generation}")


def _manifest(path: str, generation: int) -> str:
    return os.path.join(path, "manifest", f"generation={generation}")


def _found(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("recursiveFileLookup", "false").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _generation(spark: SparkSession, path: str) -> int | None:
    """The newest generation that a manifest makes valid."""
    manifests = _found(spark, os.path.join(path, "manifest"))
    return None if manifests is None else manifests.agg(F.max("generation")).first()[0]


def _parts(spark: SparkSession, path: str) -> tuple[int | None, list[DataFrame], DataFrame | None]:
    """(generation, counts to add up, all counts of single updates)."""
    generation, deltas = _generation(spark, path), _found(spark, _deltas(path))
    parts = [] if generation is None else [spark.read.parquet(_merged(path, generation))]
    if deltas is not None:
        fresh = deltas
        if generation is not None:
            held = spark.read.parquet(_manifest(path, generation)).select(F.col("query").alias("_query"), "last_update")
            fresh = deltas.join(held, (F.col("query").cast("string") == F.col("_query")) & (F.col("update") <= F.col("last_update")), "left_anti")
        parts.append(fresh.drop("query", "update"))
    if not parts:
        raise ValueError(f"no counts under {path}")
    return generation, parts, deltas


def _summed(parts: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    rows = parts[0].select(*keys, *values)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*keys, *values))
    return rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def read_counts(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> DataFrame:
    """The sums over all micro-batches that ``write_counts`` wrote, merged ones included."""
    return _summed(_parts(spark, path)[1], keys, values)


def merge_counts(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> None:
    """Merge all counts so far into a new generation, then remove what it was made of."""
    generation, parts, deltas = _parts(spark, path)
    if deltas is None:
        return
    new = 0 if generation is None else generation + 1
    updates = deltas.select(F.col("query").cast("string").alias("query"), "update").distinct()
    gone = [(row["query"], row["update"]) for row in updates.collect()]  # at most the updates since the last merge
    held = updates.groupBy("query").agg(F.max("update").cast("bigint").alias("last_update"))
    if generation is not None:
        held = held.unionByName(spark.read.parquet(_manifest(path, generation)).select("query", "last_update"))
        held = held.groupBy("query").agg(F.max("last_update").alias("last_update"))
    _summed(parts, keys, values).write.mode("overwrite").parquet(_merged(path, new))
    held.coalesce(1).write.mode("overwrite").parquet(_manifest(path, new))  # from here on the new one counts
    for query, update in gone:
        remove_path(spark, os.path.join(_deltas(path), f"query={query}", f"update={update}"))
    if generation is not None:
        remove_path(spark, _merged(path, generation))
        remove_path(spark, _manifest(path, generation))
