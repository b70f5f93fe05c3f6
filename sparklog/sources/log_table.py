"""The stored log table: Parquet, partitioned by UTC day and by the batch that wrote it.

Partitions are (day, run_id, batch_id), and every row keeps the batch it came with in ``origin``. A
batch is written, then committed: one small file in ``<table>_commits``. A batch that is committed is
never written again, so a replay adds nothing, also after its rows have been compacted or archived.

Compaction and archive are noted before they change anything, readers go by the notes, and a run
that died is finished or undone by the next one. Lists of partitions come from the catalog, day by
day, and the notes themselves are rows of small tables.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.schema import DISK_GUARD_BYTES, LOG_COLUMNS, LOG_SCHEMA, NS_PER_DAY, RETENTION_DAYS
from sparklog.session import dynamic_overwrite

# A Bloom filter on trace_id lets a trace lookup skip files; it grows only as far as needed.
FILE_OPTIONS = {
    "parquet.bloom.filter.enabled#trace_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.max.bytes": "1048576",
}
PARTITION_COLUMNS = ["day", "run_id", "batch_id"]
STORED_COLUMNS = [*[c for c in LOG_COLUMNS if c != "day"], "origin", *PARTITION_COLUMNS]
SORT_COLUMNS = [*PARTITION_COLUMNS, "service", "severity", "time_ns"]
COMPACTED = "compacted"
_JOURNAL = "sparklog.compaction."
#: Batches whose commits share a folder, so that looking one up reads so many small files at most.
COMMIT_BLOCK = 100
#: Partitions dropped by one statement.
DROPPED_AT_ONCE = 200
_RUN_ID = re.compile(r"[A-Za-z0-9._-]+")


def create_log_table(spark: SparkSession, table: str) -> None:
    """Create the table and its commits and merges if they are not there yet; partitions come with the writes."""
    fields = [f for f in LOG_SCHEMA.fields if f.name != "day"]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    options = ", ".join(f"'{key}' = '{value}'" for key, value in FILE_OPTIONS.items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, origin STRING, day DATE, run_id STRING, batch_id BIGINT) "
        f"USING parquet OPTIONS ({options}) PARTITIONED BY ({', '.join(PARTITION_COLUMNS)})"
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {commits_of(table)} (batch_id BIGINT, days ARRAY<DATE>, run_id STRING, block BIGINT) "
        "USING parquet PARTITIONED BY (run_id, block)"
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {merges_of(table)} (generation BIGINT, source STRING, day DATE) "
        "USING parquet PARTITIONED BY (day)"
    )


def commits_of(table: str) -> str:
    return f"{table}_commits"


def merges_of(table: str) -> str:
    return f"{table}_merges"


def location(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE FORMATTED {table}").where(F.col("col_name") == "Location").first().data_type


def is_committed(spark: SparkSession, table: str, run_id: str, batch_id: int) -> bool:
    found = spark.table(commits_of(table)).where(
        (F.col("run_id") == run_id) & (F.col("block") == batch_id // COMMIT_BLOCK) & (F.col("batch_id") == batch_id)
    )
    return not found.isEmpty()


def _commit(spark: SparkSession, table: str, run_id: str, batch_id: int) -> None:
    """Note a written batch and the days it has rows on; a batch without rows needs no note."""
    days = sorted({p["day"] for p in _partitions(spark, table, run_id=run_id, batch_id=batch_id)})
    if not days:
        return
    row = spark.range(1).select(
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.array(*[F.lit(dt.date.fromisoformat(day)) for day in days]).alias("days"),
        F.lit(run_id).alias("run_id"),
        F.lit(batch_id // COMMIT_BLOCK).cast("bigint").alias("block"),
    )
    row.coalesce(1).write.insertInto(commits_of(table))


def write_batch(df: DataFrame, table: str, run_id: str, batch_id: int) -> None:
    """Write accepted rows under (run_id, batch_id), each to the day of its own time, and commit the batch.

    The rebalance spreads a heavy day over several files and joins small ones; within a file
    rows are sorted so that min/max statistics prune by service, severity and time. What a run that
    died before its commit has left is overwritten; a batch that is committed stays as it is.
    """
    spark = df.sparkSession
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"run_id: letters, digits, '.', '_' and '-' only, got {run_id!r}")
    if is_committed(spark, table, run_id, batch_id):
        return
    rows = (
        df.select(*LOG_COLUMNS)
        .withColumn("origin", F.lit(f"{run_id}/{batch_id}"))
        .withColumn("run_id", F.lit(run_id))
        .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .hint("rebalance", "day")
        .sortWithinPartitions(*SORT_COLUMNS)
    )
    with dynamic_overwrite(spark):
        rows.select(*STORED_COLUMNS).write.insertInto(table, overwrite=True)
    _commit(spark, table, run_id, batch_id)


def stored_rows(spark: SparkSession, table: str) -> DataFrame:
    """All columns of all stored rows, each row once, also while a day is being compacted.

    Until the merged files of a day are complete they are left out, from then on their sources are.
    """
    rows = spark.table(table)
    for day, (generation, state) in _open_merges(spark, table).items():
        own = F.col("day") == F.lit(dt.date.fromisoformat(day))
        if state == "writing":
            left_out = (F.col("run_id") == COMPACTED) & (F.col("batch_id") == generation)
        else:
            left_out = _batch_name().isin(_sources(spark, table, day, generation))
        rows = rows.where(~(own & left_out))
    return rows


def read_logs(spark: SparkSession, table: str) -> DataFrame:
    return stored_rows(spark, table).select(*LOG_COLUMNS)


def _batch_name() -> Column:
    return F.concat_ws("/", "run_id", F.col("batch_id").cast("string"))


def _partitions(spark: SparkSession, table: str, **spec) -> list[dict[str, str]]:
    """Partitions from the catalog: those of a day, of a batch, or all."""
    given = ", ".join(f"{name}='{value}'" if name != "batch_id" else f"{name}={value}" for name, value in spec.items())
    rows = spark.sql(f"SHOW PARTITIONS {table}" + (f" PARTITION ({given})" if given else "")).collect()
    return [dict(part.split("=", 1) for part in row.partition.split("/")) for row in rows]


def partition_days(spark: SparkSession, table: str) -> DataFrame:
    """Stored days in ascending order, from the catalog."""
    parts = spark.sql(f"SHOW PARTITIONS {table}")
    day = F.regexp_extract("partition", r"(?:^|/)day=([^/]+)", 1).cast("date").alias("day")
    return parts.select(day).distinct().orderBy("day")


def _drop(spark: SparkSession, table: str, parts: list[dict[str, str]]) -> None:
    for low in range(0, len(parts), DROPPED_AT_ONCE):
        specs = ", ".join(
            f"PARTITION (day='{p['day']}', run_id='{p['run_id']}', batch_id={p['batch_id']})"
            for p in parts[low : low + DROPPED_AT_ONCE]
        )
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


def drop_days(spark: SparkSession, table: str, days: list[str | dt.date]) -> list[str]:
    """Drop whole days. A day that is not stored is no error, a malformed one is."""
    names = {str(d) if isinstance(d, dt.date) else str(dt.date.fromisoformat(d)) for d in days}
    dropped = []
    for name in sorted(names):
        if doomed := _partitions(spark, table, day=name):
            _drop(spark, table, doomed)
            dropped.append(name)
    return dropped


def expired_days(spark: SparkSession, table: str, now_ns: int, keep_days: int = RETENTION_DAYS) -> list[str]:
    if keep_days < 1:
        raise ValueError(f"retention must be at least one day, got {keep_days}")
    cutoff = dt.date(1970, 1, 1) + dt.timedelta(days=now_ns // NS_PER_DAY - keep_days)
    days = partition_days(spark, table).where(F.col("day") < F.lit(cutoff))
    return [str(row.day) for row in days.collect()]


def retain(spark: SparkSession, table: str, now_ns: int, keep_days: int = RETENTION_DAYS) -> list[str]:
    """Drop every day older than the retention; returns the days dropped."""
    return drop_days(spark, table, expired_days(spark, table, now_ns, keep_days))


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}.manifest"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """(day, copy, origin): which batches of a day each finished copy holds."""
    schema = "day date, copy string, origin string"
    try:
        return spark.read.schema(schema).parquet(manifest_path(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def archive(spark: SparkSession, table: str, path: str, days: list[str], drop: bool = True) -> None:
    """Copy days to zstd Parquet, then drop from the table what the archive holds.

    The manifest beside the archive records every batch of every finished copy. A copy adds the batches
    that are not recorded, wherever compaction has put their rows, and is recorded after it is written. So a
    copy may be repeated, and a copy that died is not recorded, hence not read. A partition is dropped
    when all batches with rows in it are recorded.
    """
    for day in sorted(set(days)):
        date = F.lit(dt.date.fromisoformat(day))
        listed = _partitions(spark, table, day=day)
        if not listed:
            continue
        finish_compaction(spark, table, day)
        rows = stored_rows(spark, table).where(F.col("day") == date)
        known = _manifest(spark, path).where(F.col("day") == date).select("origin").distinct()
        fresh = rows.join(known, "origin", "left_anti")
        origins = [row.origin for row in fresh.select("origin").distinct().collect()]  # the batches of one day
        if origins:
            copy = uuid.uuid4().hex[:16]
            (
                fresh.where(F.col("origin").isin(origins))
                .select(*LOG_COLUMNS, "origin", F.lit(copy).alias("copy"))
                .repartitionByRange("service", "severity", "time_ns")
                .sortWithinPartitions("service", "severity", "time_ns")
                .write.mode("append")
                .option("compression", "zstd")
                .partitionBy("day", "copy")
                .parquet(path)
            )
            recorded = spark.createDataFrame([(dt.date.fromisoformat(day), copy, o) for o in origins], "day date, copy string, origin string")
            recorded.coalesce(1).write.mode("append").parquet(manifest_path(path))
        if drop:
            held = _manifest(spark, path).where(F.col("day") == date).select("origin").distinct()
            rest = rows.select("origin", "run_id", "batch_id").distinct().join(held, "origin", "left_anti")
            kept = {(row.run_id, str(row.batch_id)) for row in rest.select("run_id", "batch_id").distinct().collect()}
            still = _partitions(spark, table, day=day)
            seen = {(p["run_id"], p["batch_id"]) for p in listed}
            _drop(spark, table, [p for p in still if (p["run_id"], p["batch_id"]) in seen - kept])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archived rows: those of the copies that the manifest records."""
    copies = _manifest(spark, path).select("day", "copy").distinct()
    if copies.isEmpty():
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.parquet(path).join(copies, ["day", "copy"], "left_semi").select(*LOG_COLUMNS)


def partition_bytes(spark: SparkSession, table: str) -> DataFrame:
    """Per day: files and stored bytes, from the listing of the table's files; no row is read."""
    if not spark.sql(f"SHOW PARTITIONS {table}").limit(1).count():
        return spark.createDataFrame([], "day date, files bigint, byte_size bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(location(spark, table))
    return files.groupBy(F.col("day").cast("date").alias("day")).agg(
        F.count("*").alias("files"), F.sum("length").cast("bigint").alias("byte_size")
    )


def over_limit_days(spark: SparkSession, table: str, limit: int = DISK_GUARD_BYTES) -> DataFrame:
    """(day, byte_size) of the days whose files passed the limit."""
    return partition_bytes(spark, table).where(F.col("byte_size") > limit)


def _open_merges(spark: SparkSession, table: str) -> dict[str, tuple[int, str]]:
    """Days being compacted: the generation of the merged files, and whether they are complete (``dropping``)."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key").startswith(_JOURNAL)).collect()
    notes = {row.key.removeprefix(_JOURNAL): row.value.split(":") for row in rows}
    return {day: (int(generation), state) for day, (generation, state) in notes.items()}


def _sources(spark: SparkSession, table: str, day: str, generation: int) -> list[str]:
    """The batches that a generation of a day was made of."""
    notes = spark.table(merges_of(table)).where(
        (F.col("day") == F.lit(dt.date.fromisoformat(day))) & (F.col("generation") == generation)
    )
    return [row.source for row in notes.select("source").distinct().collect()]


def _note(spark: SparkSession, table: str, day: str, generation: int, state: str) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_JOURNAL}{day}' = '{generation}:{state}')")


def finish_compaction(spark: SparkSession, table: str, day: str) -> None:
    """Finish or undo what a compaction that died has left; nothing to do if there is none."""
    if day not in (notes := _open_merges(spark, table)):
        return
    generation, state = notes[day]
    stored = _partitions(spark, table, day=day)
    if state == "writing":
        doomed = [p for p in stored if (p["run_id"], p["batch_id"]) == (COMPACTED, str(generation))]
    else:
        sources = set(_sources(spark, table, day, generation))
        doomed = [p for p in stored if f"{p['run_id']}/{p['batch_id']}" in sources]
    _drop(spark, table, doomed)
    spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('{_JOURNAL}{day}')")


def compact_day(spark: SparkSession, table: str, day: str) -> None:
    """Merge the batches of a day into few sorted files; rows keep their origin.

    The sources are rows of ``<table>_merges``. One table property says whether readers go by the
    sources or by the merged files, and its change from the one to the other is a single step.
    """
    finish_compaction(spark, table, day)
    stored = _partitions(spark, table, day=day)
    if len(stored) < 2:
        return
    date = F.lit(dt.date.fromisoformat(day))
    past = spark.table(merges_of(table)).where(F.col("day") == date).agg(F.max("generation")).first()[0]
    generation = 0 if past is None else past + 1
    names = [f"{p['run_id']}/{p['batch_id']}" for p in stored]
    notes = spark.createDataFrame([(generation, name) for name in names], "generation bigint, source string")
    notes.withColumn("day", date).coalesce(1).write.insertInto(merges_of(table))
    _note(spark, table, day, generation, "writing")
    merged = (
        spark.table(table)
        .where((F.col("day") == date) & _batch_name().isin(names))
        .withColumn("run_id", F.lit(COMPACTED))
        .withColumn("batch_id", F.lit(generation).cast("bigint"))
        .repartitionByRange("service", "severity", "time_ns")
        .sortWithinPartitions(*SORT_COLUMNS)
    )
    with dynamic_overwrite(spark):
        merged.select(*STORED_COLUMNS).write.insertInto(table, overwrite=True)
    _note(spark, table, day, generation, "dropping")
    finish_compaction(spark, table, day)
