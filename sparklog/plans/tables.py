"""Registered queries over a stored, day-partitioned log table written from the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.operators import query as q
from sparklog.operators import stored
from sparklog.operators.summary import distinct_services
from sparklog.plans.reads import NEWEST, SINCE, SINCE_NS, UNTIL, UNTIL_NS
from sparklog.plans.registry import SQL_SHOWN, from_logs, registered, shown
from sparklog.schema import LOG_COLUMNS
from sparklog.session import scratch_path
from sparklog.sources import log_table as store
from sparklog.sources.driver_tables import INGEST_NS, logs_from_events


def new_table(spark: SparkSession) -> str:
    """A managed table in a fresh database under the shared folder."""
    database = f"logs_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, database)}'")
    store.create_log_table(spark, f"{database}.logs")
    return f"{database}.logs"


def stored_events(spark: SparkSession, sf_dir: str) -> str:
    """Two batches, the second replayed."""
    name = new_table(spark)
    logs = logs_from_events(spark, sf_dir)
    errors = F.col("severity") >= 17
    store.write_batch(logs.where(~errors), name, "run-a", 0)
    for _ in range(2):
        store.write_batch(logs.where(errors), name, "run-a", 1)
    return name


def _per_day(logs: DataFrame) -> DataFrame:
    days = logs.groupBy("day").agg(F.count("*").alias("records"), F.count_distinct("record_id").alias("ids"))
    return days.withColumn("day", F.col("day").cast("string"))


SQL_PER_DAY = "SELECT CAST(day AS VARCHAR) AS day, count(*) AS records, count(DISTINCT record_id) AS ids FROM logs"


@registered(
    from_logs(f"""SELECT {SQL_SHOWN} FROM logs WHERE service IN ('app-error', 'app-signup')
    AND time_ns >= {SINCE_NS} AND time_ns < {UNTIL_NS} {NEWEST} 100""")
)
def stored_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = store.read_logs(spark, stored_events(spark, sf_dir))
    return shown(q.query_logs(logs, services=["app-error", "app-signup"], since=SINCE, until=UNTIL))


@registered(from_logs(f"{SQL_PER_DAY} GROUP BY day"))
def stored_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_day(store.read_logs(spark, stored_events(spark, sf_dir)))


@registered(from_logs("SELECT DISTINCT CAST(day AS VARCHAR) AS day FROM logs"))
def stored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = store.partition_days(spark, stored_events(spark, sf_dir))
    return days.select(F.col("day").cast("string").alias("day"))


@registered(from_logs("SELECT DISTINCT service FROM logs"))
def stored_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_services(store.read_logs(spark, stored_events(spark, sf_dir)))


@registered(from_logs("SELECT CAST(day AS VARCHAR) AS day, true AS has_files, true AS has_bytes FROM logs GROUP BY day"))
def stored_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = store.partition_bytes(spark, stored_events(spark, sf_dir))
    return sizes.select(F.col("day").cast("string").alias("day"), (F.col("files") > 0).alias("has_files"), (F.col("byte_size") > 0).alias("has_bytes"))


@registered(from_logs(f"{SQL_PER_DAY} WHERE day = DATE '2024-01-05' GROUP BY day"))
def archived_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a day archived, the other half landing late and archived after it."""
    name, path = new_table(spark), scratch_path(spark, "archive")
    logs = logs_from_events(spark, sf_dir).where("day = DATE '2024-01-05'")
    for batch, half in enumerate((F.col("severity") >= 9, F.col("severity") < 9)):
        store.write_batch(logs.where(half), name, "half", batch)
        store.archive(spark, name, path, ["2024-01-05"])
    return _per_day(store.read_archive(spark, path))


@registered(from_logs(f"{SQL_PER_DAY} WHERE day IN (DATE '2024-01-05', DATE '2024-01-06') GROUP BY day"))
def archived_after_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies without drop, compaction, a late batch, and a copy that was never recorded: each id once."""
    name, path = new_table(spark), scratch_path(spark, "archive")
    days = ["2024-01-05", "2024-01-06"]
    logs = logs_from_events(spark, sf_dir).where(F.col("day").cast("string").isin(days))
    kinds = [F.col("severity") >= 13, F.col("severity").between(6, 12), F.col("severity") < 6]
    for batch in (0, 1):
        store.write_batch(logs.where(kinds[batch]), name, "part", batch)
        store.archive(spark, name, path, days, drop=False)
    lost = logs.where("day = DATE '2024-01-05'").withColumn("origin", F.lit("part/9")).withColumn("copy", F.lit("died"))
    lost.select(*LOG_COLUMNS, "origin", "copy").write.mode("append").partitionBy("day", "copy").parquet(path)
    store.compact_day(spark, name, days[0])
    store.write_batch(logs.where(kinds[2]), name, "part", 2)
    store.write_batch(logs.where(kinds[1]), name, "part", 1)
    for _ in range(2):
        store.archive(spark, name, path, days)
    return _per_day(store.read_archive(spark, path).unionByName(store.read_logs(spark, name)))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs WHERE severity >= 9 {NEWEST} 100"))
def stored_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stored.stored_newest(spark, stored_events(spark, sf_dir), min_severity="INFO"))


@registered(from_logs(f"{SQL_PER_DAY} WHERE day NOT IN (DATE '2024-01-05', DATE '2024-01-09') GROUP BY day"))
def dropped_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = stored_events(spark, sf_dir)
    store.drop_days(spark, name, ["2024-01-05", "2024-01-09", "1999-12-31"])
    return _per_day(store.read_logs(spark, name))


@registered(from_logs(f"{SQL_PER_DAY} WHERE day >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY day"))
def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = stored_events(spark, sf_dir)
    store.retain(spark, name, INGEST_NS, 7)
    return _per_day(store.read_logs(spark, name))


@registered(from_logs(f"{SQL_PER_DAY} WHERE day < DATE '2024-01-31' - INTERVAL 20 DAY GROUP BY day"))
def archived_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = stored_events(spark, sf_dir)
    path = scratch_path(spark, "archive")
    store.archive(spark, name, path, store.expired_days(spark, name, INGEST_NS, 20))
    return _per_day(store.read_archive(spark, path))


@registered(from_logs(f"{SQL_PER_DAY} GROUP BY day"))
def compacted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = stored_events(spark, sf_dir)
    for day in ("2024-01-02", "2024-01-03"):
        store.compact_day(spark, name, day)
    return _per_day(store.read_logs(spark, name))
