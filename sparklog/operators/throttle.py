"""Keep a row only if enough time has passed since the last row kept for its key.

The rule is sequential: what is kept depends on what was kept before. Keys with few rows
are folded one by one. A key with very many rows is never gathered; for it every instant
gets a pointer to the instant that would be kept next, and the kept chain is followed by
doubling the pointers, so a chain of n rows takes about log2(n) evenly spread joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.schema import THROTTLE_GAP_NS
from sparklog.session import shared_dir

# Rows of one key that a single task may fold.
FOLD_ROWS = 20_000
_SLOT = "throttle_slot"


def throttle(
    df: DataFrame, keys: list[str] | None = None, gap_ns: int = THROTTLE_GAP_NS, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Rows kept: the first of each key, then each row at least ``gap_ns`` after the last kept.

    Rows are taken in (time_ns, record_id) order. Without keys all rows share one slot. With a
    gap of zero or less every row is due, so all are kept. ``fold_rows`` only says how a key is
    worked on; what is kept does not depend on it.
    """
    if gap_ns <= 0:
        return df
    # As a struct, a NULL key is a key like any other in joins.
    named = df.withColumn(_SLOT, F.struct(*(keys or [F.lit(0).alias("all")])))
    by = [_SLOT]
    slim = named.select(*by, "time_ns", "record_id")
    sizes = slim.groupBy(*by).agg(F.count("*").alias("rows"), F.min("time_ns").alias("first_ns"))
    big = sizes.where(F.col("rows") > fold_rows)
    if big.isEmpty():
        kept = _fold(slim, by, gap_ns)
    else:
        small = slim.join(big.select(*by), by, "left_anti")
        kept = _fold(small, by, gap_ns).unionByName(_chain(slim, big, by, gap_ns, fold_rows))
    # Matched on the whole row identity, so the join spreads evenly whatever the keys are.
    whole = named.join(kept, [*by, "time_ns", "record_id"], "left_semi")
    return whole.select(*df.columns)


def _fold(slim: DataFrame, by: list[str], gap_ns: int) -> DataFrame:
    row = F.struct("time_ns", "record_id")
    runs = slim.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.slice("rows", 1, 1)

    def step(kept: Column, candidate: Column) -> Column:
        due = candidate["time_ns"] - F.element_at(kept, -1)["time_ns"] >= gap_ns
        return F.when(due, F.array_append(kept, candidate)).otherwise(kept)

    return runs.select(*by, F.inline(F.aggregate("rows", start, step)))


def _chain(slim: DataFrame, big: DataFrame, by: list[str], gap_ns: int, fold_rows: int) -> DataFrame:
    shared_dir(slim.sparkSession)  # checkpoints below go to the shared folder
    slices = big.agg(F.sum("rows")).first()[0] // fold_rows + 1
    firsts = big.select(*by, "first_ns")
    instants = (
        slim.groupBy(*by, "time_ns").agg(F.min("record_id").alias("record_id")).join(firsts, by).checkpoint()
    )
    jump = _next_kept(instants, by, gap_ns, slices).checkpoint()
    reached = instants.where(F.col("time_ns") == F.col("first_ns")).select(*by, "time_ns").checkpoint()
    while True:
        step = reached.withColumnRenamed("time_ns", "from_ns").join(jump, [*by, "from_ns"])
        ahead = step.select(*by, F.col("to_ns").alias("time_ns")).checkpoint()
        if ahead.isEmpty():
            break
        reached = reached.unionByName(ahead).checkpoint()
        onward = jump.withColumnRenamed("from_ns", "mid_ns").withColumnRenamed("to_ns", "end_ns")
        jump = (
            jump.withColumnRenamed("to_ns", "mid_ns")
            .join(onward, [*by, "mid_ns"])
            .select(*by, "from_ns", F.col("end_ns").alias("to_ns"))
            .checkpoint()
        )
    return instants.join(reached, [*by, "time_ns"], "left_semi").select(*by, "time_ns", "record_id")


def _next_kept(instants: DataFrame, by: list[str], gap_ns: int, slices: int) -> DataFrame:
    """(key, from_ns, to_ns): the first instant at least ``gap_ns`` after each instant."""
    seen = instants.select(*by, F.col("time_ns").alias("at"), F.col("time_ns").alias("seen"))
    asks = instants.select(*by, (F.col("time_ns") + gap_ns).alias("at"), F.lit(None).cast("bigint").alias("seen"))
    # Slices hold about equally many rows, however far apart in time; one moment stays in one slice.
    both = (
        seen.unionByName(asks)
        .repartitionByRange(2 * slices, *by, "at")
        .withColumn("slice", F.spark_partition_id())
        .checkpoint()
    )
    # Backwards in time, instants before the questions of the same moment: the last instant
    # seen so far is the nearest at or after.
    back = Window.partitionBy(*by, "slice").orderBy(F.desc("at"), F.col("seen").isNull())
    running = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = both.withColumn("here", F.last("seen", ignorenulls=True).over(running)).where(F.col("seen").isNull())
    # A question with nothing left in its slice goes to the first instant of a later slice.
    later = Window.partitionBy(*by).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    after = (
        both.groupBy(*by, "slice")
        .agg(F.min("seen").alias("first"))
        .withColumn("later", F.min("first").over(later))
        .select(*by, "slice", "later")
    )
    return (
        answered.join(after, [*by, "slice"])
        .select(*by, (F.col("at") - gap_ns).alias("from_ns"), F.coalesce("here", "later").alias("to_ns"))
        .where(F.col("to_ns").isNotNull())
    )
