"""Live tail: the query predicates on what is committed to a log table, or on any stream of log rows.

A tail of a table follows its commits, one small file for each batch, which are never rewritten. The
rows of a commit are looked up by their origin, in the batch's own partition or in the merged one that
compaction has put them in. So a tail that was stopped, or is slower than compaction, misses nothing, and
a replayed batch, which has one commit, is told once. The checkpoint is the cursor.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sparklog.operators.query import filter_logs, to_json_records
from sparklog.schema import LOG_COLUMNS
from sparklog.sources.log_table import COMPACTED, commits_of, location, stored_rows

#: Commits that one micro-batch of a tail takes.
COMMITS_PER_TRIGGER = 100


def commit_stream(spark: SparkSession, table: str, per_trigger: int = COMMITS_PER_TRIGGER) -> DataFrame:
    """(batch_id, days, run_id, block) of the batches committed to the table, as a stream."""
    commits = commits_of(table)
    reader = spark.readStream.schema(spark.table(commits).schema).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(location(spark, commits))


def committed_rows(spark: SparkSession, table: str, commits: DataFrame) -> DataFrame:
    """The rows of some commits, wherever they are stored by now. Their days and batches prune the scan."""
    named = commits.select("run_id", "batch_id", "days").collect()  # as many as a trigger takes
    days = sorted({day for row in named for day in row.days})
    ids = [row.batch_id for row in named]
    own = F.col("run_id").isin([row.run_id for row in named]) & F.col("batch_id").between(min(ids, default=0), max(ids, default=0))
    rows = stored_rows(spark, table).where(F.col("day").isin(days) & (own | (F.col("run_id") == COMPACTED)))
    return rows.where(F.col("origin").isin([f"{row.run_id}/{row.batch_id}" for row in named])).select(*LOG_COLUMNS)


def start_tail(
    spark: SparkSession,
    table: str,
    deliver: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = True,
    interval: str = "15 seconds",
    per_trigger: int = COMMITS_PER_TRIGGER,
    **filters,
) -> StreamingQuery:
    """Hand the matching rows of new commits to ``deliver(rows, number)``, from where the checkpoint stopped.

    A number that comes again after a crash brings the same commits, so a ``deliver`` that overwrites what
    it wrote under a number tells every row once.
    """

    def tell(commits: DataFrame, number: int) -> None:
        deliver(filter_logs(committed_rows(commits.sparkSession, table, commits), **filters), number)

    writer = commit_stream(spark, table, per_trigger).writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": interval})).start()


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A ``deliver`` that keeps the rows as Parquet, a folder for each number."""

    def deliver(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(path, f"update={number}"))

    return deliver


def tail_logs(stream: DataFrame, **filters) -> DataFrame:
    """Rows of any stream of log rows that match the filters of ``log_filter``."""
    return filter_logs(stream, **filters)


def tail_json(stream: DataFrame, **filters) -> DataFrame:
    """The same as one JSON text per row."""
    return to_json_records(tail_logs(stream, **filters))
