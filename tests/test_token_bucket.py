"""The token bucket against a replay of its rule row by row."""

from __future__ import annotations

import random

import pytest
from log_fixtures import HOUR, NOW, SECOND
from pyspark.sql import functions as F

from sparklog.operators import token_bucket as bucket
from sparklog.streaming.tail import to_folder

MINUTE = 60 * SECOND


def replayed(rows, tokens, period, capacity):
    """(key, record_id) kept; rows are (key, ingest_ns, record_id)."""
    tick_ns, state, kept = period // tokens, {}, []
    for key, at, record_id in sorted(rows, key=lambda r: (r[1], r[2])):
        tick = at // tick_ns
        level, last = state.get(key, (capacity, tick))
        level = min(capacity, level + tick - last)
        if level >= 1:
            kept.append((key, record_id))
        state[key] = (max(level - 1, 0), tick)
    return sorted(kept, key=str)


def rows_of(seed, n=600):
    """Bursts, idle stretches, equal instants, a minute's edge, a hot key and a key that is NULL."""
    draw = random.Random(seed)
    rows, at = [], NOW - 5 * SECOND
    for i in range(n):
        at += draw.choice([0, 0, SECOND // 10, SECOND, 3 * SECOND, draw.choice([0, 0, 0, HOUR])])
        rows.append((draw.choice(["hot", "hot", "hot", "cool", None]), at, f"r{draw.randrange(10**6)}-{i}"))
    return rows


def kept_by(spark, rows, **options):
    df = spark.createDataFrame(rows, "service string, ingest_ns bigint, record_id string").withColumn("message", F.lit("m"))
    return sorted(((r.service, r.record_id) for r in bucket.token_bucket(df, "service", **options).collect()), key=str)


@pytest.mark.parametrize(("tokens", "capacity", "width"), [(10, 10, 128), (10, 3, 2), (7, 20, 3), (1, 1, 2), (1000, 1000, 4)])
def test_batch_equals_replay(spark, monkeypatch, tokens, capacity, width):
    monkeypatch.setattr(bucket, "WIDTH", width)
    for seed in (1, 2):
        rows = rows_of(seed)
        got = kept_by(spark, rows, tokens=tokens, period_ns=MINUTE, capacity=capacity)
        assert got == replayed(rows, tokens, MINUTE, capacity)
        assert tokens == 1000 or len(got) < len(rows)


def test_limits(spark):
    assert kept_by(spark, [("a", NOW + i, str(i)) for i in range(5)], tokens=2) == [("a", "0"), ("a", "1")]
    assert kept_by(spark, []) == []
    with pytest.raises(ValueError, match="tokens"):
        kept_by(spark, [], tokens=0)


def test_stream_equals_replay_and_forgets_full_buckets(spark, scratch):
    """Micro-batches cut the rows anywhere; a row stamped years ahead by its client earns and costs nothing."""
    rows = sorted(rows_of(5), key=lambda r: (r[1], r[2]))
    df = spark.createDataFrame([(*row, row[1] + (10**18 if i % 50 == 0 else 0)) for i, row in enumerate(rows)], "service string, ingest_ns bigint, record_id string, time_ns bigint")
    cuts = [0, 1, 200, 201, 450, len(rows)]
    source, out = scratch("source"), scratch("bucket")
    for low, high in zip(cuts, cuts[1:], strict=False):
        ids = [r[2] for r in rows[low:high]]
        df.where(F.col("record_id").isin(ids)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    limit = bucket.bucket_micro_batch(to_folder(f"{out}/rows"), f"{out}/levels", "service", tokens=10, period_ns=MINUTE, capacity=5)
    stream.writeStream.foreachBatch(limit).option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted(((r.service, r.record_id) for r in spark.read.parquet(f"{out}/rows").collect()), key=str)
    assert got == replayed(rows, 10, MINUTE, 5)
    # a replay of the last micro-batch starts from the same levels
    before = spark.read.parquet(f"{out}/levels/update=4").collect()
    limit(spark.read.parquet(source).where(F.col("record_id").isin([r[2] for r in rows[450:]])), 4)
    assert sorted(spark.read.parquet(f"{out}/levels/update=4").collect(), key=str) == sorted(before, key=str)
    late = spark.createDataFrame([("other", rows[-1][1] + HOUR, "x", NOW)], df.schema)
    limit(late, 5)
    assert [r.slot.key for r in spark.read.parquet(f"{out}/levels/update=5").collect()] == ["other"]
