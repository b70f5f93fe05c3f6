"""Pages of a query, joined by an opaque cursor.

A cursor holds where the last page ended, how many rows of that very time and record id it showed, and a
digest of the filters. So rows that share time and id, as those of byte-identical lines do, are
neither skipped nor shown twice, rows that arrive with a newer time change no later page, and a cursor
of another query is refused.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.operators.query import filter_logs, newest, row_limit
from sparklog.schema import LOG_COLUMNS
from sparklog.session import scratch_path


@dataclass(frozen=True)
class Page:
    """The rows of a page, newest first, and the cursor of the next one; None after the last."""

    rows: DataFrame
    next_cursor: str | None


def _digest(filters: dict) -> str:
    shown = json.dumps(sorted((name, repr(value)) for name, value in filters.items() if value is not None))
    return hashlib.sha256(shown.encode()).hexdigest()[:16]


def _cursor(time_ns: int, record_id: str, shown: int, filters: dict) -> str:
    text = json.dumps([1, time_ns, record_id, shown, _digest(filters)], separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def read_cursor(cursor: str, filters: dict) -> tuple[int, str, int]:
    """(time_ns, record_id, rows of these shown) of a cursor of the same query."""
    try:
        version, time_ns, record_id, shown, digest = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        known = version == 1 and isinstance(time_ns, int) and isinstance(record_id, str) and isinstance(shown, int)
    except (ValueError, TypeError):
        known = False
    if not known:
        raise ValueError("cursor: not a cursor of this library")
    if digest != _digest(filters):
        raise ValueError("cursor: it belongs to a query with other filters")
    return time_ns, record_id, shown


def after_cursor(df: DataFrame, time_ns: int, record_id: str, shown: int) -> DataFrame:
    """The rows that come after the first ``shown`` of that time and id."""
    back = filter_logs(df, until=time_ns + 1)
    later = back.where((F.col("time_ns") < time_ns) | (F.col("record_id") > record_id))
    same = back.where((F.col("time_ns") == time_ns) & (F.col("record_id") == record_id))
    # copies of one line: any order of equal rows is the same order
    order = Window.partitionBy("time_ns", "record_id").orderBy("ingest_ns", "message", "attrs_json")
    rest = same.withColumn("_place", F.row_number().over(order)).where(F.col("_place") > shown).drop("_place")
    return later.unionByName(rest)


def _log_rows(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in LOG_COLUMNS if c in df.columns])


def page_logs(df: DataFrame, limit: int | None = None, cursor: str | None = None, **filters) -> Page:
    """A page of the newest matching rows. The keys of its rows, at most the row limit, go to the driver."""
    wanted = row_limit(limit)
    matching = filter_logs(df, **filters)
    bound = read_cursor(cursor, filters) if cursor is not None else None
    if bound is not None:
        matching = after_cursor(matching, *bound)
    rows = newest(_log_rows(matching), wanted, clamp=False)
    keys = [tuple(row) for row in rows.select("time_ns", "record_id").collect()]
    if len(keys) < wanted:
        return Page(rows, None)
    shown = keys.count(keys[-1]) + (bound[2] if bound is not None and bound[:2] == keys[-1] else 0)
    return Page(rows, _cursor(*keys[-1], shown, filters))


def _cursor_column(shown: Column, filters: dict) -> Column:
    """``_cursor`` over rows: the same JSON text in the same letters."""
    name = F.substring(F.to_json(F.array("record_id")), F.lit(2), F.length(F.to_json(F.array("record_id"))) - 2)
    text = F.concat(F.lit("[1,"), F.col("time_ns").cast("string"), F.lit(","), name, F.lit(","), shown.cast("string"), F.lit(f',"{_digest(filters)}"]'))
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")


def following_pages(df: DataFrame, limit: int | None = None, cursor: str | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """All pages after a cursor (or all there are) in one pass, as ``page_logs`` would show them one by one.

    Gives the rows with their ``page``, from 0, and (page, next_cursor) of every page that is full. Rows are sorted by
    ranges and stored under the shared folder, where a row's place is its place in its range plus the
    sizes of the ranges before; only these sizes are added up in one task.
    """
    wanted, spark = row_limit(limit), df.sparkSession
    matching = filter_logs(df, **filters)
    bound = read_cursor(cursor, filters) if cursor is not None else None
    if bound is not None:
        matching = after_cursor(matching, *bound)
    key = [F.desc("time_ns"), F.asc("record_id")]
    path = scratch_path(spark, "pages")
    (
        _log_rows(matching)
        .repartitionByRange(*key)
        # copies of one line in the order that ``after_cursor`` gives them
        .sortWithinPartitions(*key, *[c for c in ("ingest_ns", "message", "attrs_json") if c in matching.columns])
        .withColumn("_at", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    stored = spark.read.parquet(path)
    stored = stored.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(2**33 - 1))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("_range").agg(F.count("*").alias("_size"))
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    placed = stored.join(starts, "_range").withColumn("_at", F.col("_start") + F.col("_at")).drop("_range", "_start")
    placed = placed.withColumn("page", F.call_function("div", "_at", F.lit(wanted).cast("bigint")))

    ends = placed.where(F.pmod("_at", F.lit(wanted)) == wanted - 1).select("page", "time_ns", "record_id", F.col("_at").alias("_end"))
    keys = ends.select("time_ns", "record_id").distinct()
    same = placed.select("time_ns", "record_id", "_at").join(keys, ["time_ns", "record_id"], "left_semi")
    firsts = same.groupBy("time_ns", "record_id").agg(F.min("_at").alias("_first"))
    counted = ends.join(firsts, ["time_ns", "record_id"]).withColumn("_shown", F.col("_end") - F.col("_first") + 1)
    shown = F.col("_shown")
    if bound is not None:
        again = (F.col("time_ns") == bound[0]) & (F.col("record_id") == bound[1])
        shown = shown + F.when(again, bound[2]).otherwise(0)
    return placed.drop("_at"), counted.select("page", _cursor_column(shown, filters).alias("next_cursor"))
