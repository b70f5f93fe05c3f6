"""Rate limit by a token bucket for each key.

A bucket holds at most ``capacity`` tokens and is full at first. Tokens come one by one, at the ticks of a
clock of ``period_ns / tokens`` nanoseconds, and every row takes one if there is one. Rows go by
arrival (``ingest_ns``, then ``record_id``), so a client's clock neither earns nor costs tokens.

What is left after some rows is a clamped function of what was there before, ``min(high, max(low, x +
shift))``, and such functions compose to one of their kind. So rows are counted by key and tick, ticks
are leaves of a tree that joins WIDTH neighbours at each level, functions are composed on the way up and levels
handed down. No task ever holds more than twice WIDTH nodes of a key, however many rows it has.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.functions.times import floor_div
from sparklog.schema import NS_PER_SECOND, RATE_LIMIT_PER_MINUTE
from sparklog.session import shared_dir

#: Neighbours that one node of the tree joins.
WIDTH = 128
MINUTE_NS = 60 * NS_PER_SECOND
_NODE = ["first", "last", "shift", "low", "high"]


def token_bucket(
    df: DataFrame,
    key: str,
    tokens: int = RATE_LIMIT_PER_MINUTE,
    period_ns: int = MINUTE_NS,
    capacity: int | None = None,
    clock: str = "ingest_ns",
) -> DataFrame:
    """The rows that found a token. A NULL key is a key like any other."""
    return _limited(df, None, key, tokens, period_ns, capacity, clock)[0]


def token_bucket_levels(
    df: DataFrame,
    levels: DataFrame | None,
    key: str,
    tokens: int = RATE_LIMIT_PER_MINUTE,
    period_ns: int = MINUTE_NS,
    capacity: int | None = None,
    clock: str = "ingest_ns",
) -> tuple[DataFrame, DataFrame]:
    """(rows that found a token, levels after them) for buckets that were at ``levels`` before.

    ``levels`` has (slot, level, tick); a key that is not there has a full bucket, and buckets that have
    filled up by the newest tick are left out, so the levels are as many as keys that were busy lately.
    """
    return _limited(df, levels, key, tokens, period_ns, capacity, clock)


def _limited(df, levels, key, tokens, period_ns, capacity, clock) -> tuple[DataFrame, DataFrame]:
    capacity = capacity or tokens
    if tokens < 1 or period_ns < tokens:
        raise ValueError(f"tokens: from 1 to one for each nanosecond of the period, got {tokens}")
    shared_dir(df.sparkSession)  # checkpoints go to the shared folder
    slot, tick = F.struct(F.col(key).alias("key")).alias("bucket_slot"), floor_div(F.col(clock), period_ns // tokens).alias("bucket_tick")
    named = df.select("*", slot, tick)
    counts = named.groupBy("bucket_slot", "bucket_tick").agg(F.count("*").alias("rows")).checkpoint()
    # serving n rows: x -> max(0, x - n), for a level x of at most the capacity
    leaves = counts.select(
        "bucket_slot",
        F.col("bucket_tick").alias("first"),
        F.col("bucket_tick").alias("last"),
        (-F.col("rows")).alias("shift"),
        F.lit(0).cast("bigint").alias("low"),
        F.greatest(F.lit(capacity) - F.col("rows"), F.lit(0)).cast("bigint").alias("high"),
    )
    entries, ends = _scanned(leaves, levels, capacity)
    quota = counts.join(entries.withColumnRenamed("first", "bucket_tick"), ["bucket_slot", "bucket_tick"])
    short = quota.where(F.col("level") < F.col("rows")).select("bucket_slot", "bucket_tick", "level").checkpoint()
    plenty = named.join(short.select("bucket_slot", "bucket_tick"), ["bucket_slot", "bucket_tick"], "left_anti")
    # Of a tick without enough tokens the first rows; Spark cuts each task's to the capacity before the shuffle.
    order = Window.partitionBy("bucket_slot", "bucket_tick").orderBy(clock, "record_id")
    scarce = named.join(short.select("bucket_slot", "bucket_tick"), ["bucket_slot", "bucket_tick"], "left_semi")
    first = scarce.withColumn("bucket_place", F.row_number().over(order)).where(F.col("bucket_place") <= capacity)
    served = first.join(short, ["bucket_slot", "bucket_tick"]).where(F.col("bucket_place") <= F.col("level"))
    kept = plenty.select(*df.columns).unionByName(served.select(*df.columns))
    return kept, ends


def _refilled(level: Column, gap: Column, capacity: int) -> Column:
    return F.least(F.lit(capacity).cast("bigint"), level + F.greatest(gap, F.lit(0).cast("bigint")))


def _clamped(value: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, value))


def _composed(children: Column, capacity: int) -> Column:
    """One node of neighbouring ones: their functions, with the refill between one and the next."""

    def step(node: Column, child: Column) -> Column:
        def through(x: Column) -> Column:
            return _clamped(_refilled(x, child["first"] - node["last"], capacity) + child["shift"], child["low"], child["high"])

        # the refill stops at the capacity, so above it the function is flat
        return F.struct(
            node["first"].alias("first"),
            child["last"].alias("last"),
            (node["shift"] + (child["first"] - node["last"]) + child["shift"]).alias("shift"),
            through(node["low"]).alias("low"),
            through(node["high"]).alias("high"),
        )

    return F.aggregate(F.slice(children, 2, F.size(children)), F.get(children, F.lit(0)), step)


def _handed_down(children: Column, level: Column, tick: Column, capacity: int) -> Column:
    """(entries, level, tick): the level that each child finds, and what is left after the last."""
    kind = "array<struct<first:bigint,level:bigint>>"

    def step(state: Column, child: Column) -> Column:
        found = _refilled(state["level"], child["first"] - state["tick"], capacity)
        return F.struct(
            F.array_append(state["entries"], F.struct(child["first"].alias("first"), found.alias("level"))).alias("entries"),
            _clamped(found + child["shift"], child["low"], child["high"]).alias("level"),
            F.greatest(child["last"], state["tick"]).alias("tick"),
        )

    start = F.struct(F.array().cast(kind).alias("entries"), level.cast("bigint").alias("level"), tick.cast("bigint").alias("tick"))
    return F.aggregate(children, start, step)


def _scanned(leaves: DataFrame, levels: DataFrame | None, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(bucket_slot, first, level) of every leaf, and (slot, level, tick) after the last leaf of every slot."""
    node = F.struct(*_NODE)
    span = leaves.groupBy("bucket_slot").agg((F.max("first") - F.min("first")).alias("span")).agg(F.max("span")).first()[0] or 0
    sizes, size = [], WIDTH
    while span >= size:  # beyond that, a slot has two nodes at most
        sizes.append(size)
        size *= WIDTH
    stages, nodes = [], leaves
    for size in sizes:
        parent = floor_div(F.col("first"), size).alias("parent")
        groups = nodes.groupBy("bucket_slot", parent).agg(F.array_sort(F.collect_list(node)).alias("children")).checkpoint()
        stages.append(groups)
        nodes = groups.select("bucket_slot", F.inline(F.array(_composed(F.col("children"), capacity))))
    tops = nodes.groupBy("bucket_slot").agg(F.array_sort(F.collect_list(node)).alias("children"))
    if levels is None:
        known = tops.withColumn("level", F.lit(capacity).cast("bigint")).withColumn("tick", F.get("children", F.lit(0))["first"])
    else:
        before = levels.select(F.col("slot").alias("bucket_slot"), "level", "tick")
        known = tops.join(before, "bucket_slot", "left")
        known = known.withColumn("level", F.coalesce("level", F.lit(capacity))).withColumn("tick", F.coalesce("tick", F.get("children", F.lit(0))["first"]))
    folded = known.select("bucket_slot", _handed_down(F.col("children"), F.col("level"), F.col("tick"), capacity).alias("s")).checkpoint()
    ends = folded.select(F.col("bucket_slot").alias("slot"), "s.level", "s.tick")
    entries = folded.select("bucket_slot", F.inline("s.entries"))
    for groups in reversed(stages):
        start = groups.withColumn("first", F.get("children", F.lit(0))["first"]).join(entries, ["bucket_slot", "first"])
        down = _handed_down(F.col("children"), F.col("level"), F.col("first"), capacity)
        entries = start.select("bucket_slot", F.inline(down["entries"]))
    if levels is not None:
        rest = levels.join(ends.select("slot"), "slot", "left_anti").select("slot", "level", "tick")
        ends = ends.unionByName(rest)
    newest = ends.agg(F.max("tick").alias("newest"))  # one row
    ends = ends.join(newest, F.col("level") + (F.col("newest") - F.col("tick")) < capacity).select("slot", "level", "tick")
    return entries, ends


def bucket_micro_batch(deliver, state_path: str, key: str, **options):
    """The foreachBatch function of a limit that goes on over micro-batches.

    The levels after each micro-batch are written under its number and read by the next one, so a replayed
    micro-batch starts from the same levels. ``deliver(rows, number)`` gets the rows that found a token. All
    of a key's rows of a micro-batch are spread as in the batch operator.
    """

    def limit(batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, None
        if number > 0:
            before = spark.read.schema("slot struct<key:string>, level bigint, tick bigint").parquet(os.path.join(state_path, f"update={number - 1}"))
        rows = batch.withColumn(key, F.col(key).cast("string"))
        kept, levels = token_bucket_levels(rows, before, key, **options)
        levels.coalesce(1).write.mode("overwrite").parquet(os.path.join(state_path, f"update={number}"))
        deliver(kept, number)

    return limit
