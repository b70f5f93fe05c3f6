from __future__ import annotations

import json
import os

from log_fixtures import HOUR, NOW, SECOND
from pyspark.sql import functions as F

from sparklog.operators.ingest import accepted, ingest_batches
from sparklog.operators.safety import ingest_guards, rate_limit
from sparklog.operators.throttle import throttle
from sparklog.sources.log_table import compact_day, read_logs, write_batch
from sparklog.sources.otlp_json import read_batches
from sparklog.streaming.ingest import start_ingest
from sparklog.streaming.rolling import hourly_counts, merge_counts, read_counts, write_counts
from sparklog.streaming.stateful import rate_limit_stream, throttle_stream
from sparklog.streaming.tail import start_tail, tail_json, to_folder


def body(service, at, text):
    return json.dumps(
        {
            "resourceLogs": [
                {
                    "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]},
                    "scopeLogs": [{"logRecords": [{"timeUnixNano": str(at), "body": {"stringValue": text}}]}],
                }
            ]
        }
    )


def land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as file:
        file.write("\n".join(lines) + "\n")


def drain(stream, path):
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def test_stream_equals_batch_and_resumes(spark, log_table, scratch):
    base = scratch("ingest")
    landing, rejects = f"{base}/landing", f"{base}/rejects"
    far = 1 << 62  # the files are new, the records are not

    def run():
        start_ingest(
            spark,
            landing,
            log_table,
            f"{base}/cp",
            rejects,
            "run",
            max_files_per_trigger=1,
            max_age_ns=far,
            transform=ingest_guards,
        ).awaitTermination()

    land(landing, "a.json", [body("a", NOW, "1"), "broken"])
    land(landing, "b.json", [body("b", NOW + 1, "2"), body("b", 2**63, "no time")])
    run()
    land(landing, "c.json", [body("a", NOW + 24 * HOUR, "3")])
    run()
    stored = read_logs(spark, log_table)
    own = stored.where("service != 'ingest'")
    _, validated = ingest_batches(read_batches(spark, landing), max_age_ns=far)
    assert sorted(own.collect()) == sorted(accepted(validated).collect())
    assert own.count() == 3
    turned_away = spark.read.parquet(rejects)
    assert sorted(r.reject_reason for r in turned_away.collect()) == ["bad_format", "bad_time"]
    events = stored.where("service = 'ingest'")
    assert events.count() == 3 and {r.severity for r in events.collect()} == {9, 13}

    # Tail of the stored table: filters, and only new rows after a restart.
    told = follow(spark, log_table, scratch("tail"), services=["a"])
    assert told() == ["1", "3"]
    land(landing, "d.json", [body("a", NOW + 2, "4"), body("z", NOW + 2, "5")])
    run()
    assert told() == ["1", "3", "4"]


def follow(spark, log_table, path, **options):
    """A tail into a folder; each call lets it catch up and gives the messages told so far."""

    def told():
        start_tail(spark, log_table, to_folder(f"{path}/rows"), f"{path}/checkpoint", **options).awaitTermination()
        return sorted(r.message for r in spark.read.parquet(f"{path}/rows").collect())

    return told


def test_tail_through_compaction_and_replay(spark, log_table, make_logs, scratch):
    """What was compacted before the tail came to it is told, and what was replayed is told once."""
    batches = [make_logs([{"record_id": f"{n}-{i}", "message": f"{n}-{i}", "time_ns": NOW + n * HOUR * 12} for i in range(3)]) for n in range(5)]
    told = follow(spark, log_table, scratch("tail"), per_trigger=1)
    write_batch(batches[0], log_table, "r", 0)
    assert told() == ["0-0", "0-1", "0-2"]
    for n in (1, 2):
        write_batch(batches[n], log_table, "r", n)
    compact_day(spark, log_table, "2026-04-13")
    compact_day(spark, log_table, "2026-04-14")
    for n in (1, 2):
        write_batch(batches[n], log_table, "r", n)
    assert read_logs(spark, log_table).count() == 9
    assert len(told()) == 9
    write_batch(batches[3], log_table, "r", 3)
    compact_day(spark, log_table, "2026-04-14")
    write_batch(batches[4], log_table, "other", 0)
    assert told() == sorted(f"{n}-{i}" for n in range(5) for i in range(3)) == told()


def test_tail_as_json(spark, scratch, make_logs):
    source = scratch("source")
    logs = make_logs([{"service": "a"}, {"service": "b"}])
    logs.write.parquet(source)
    stream = tail_json(spark.readStream.schema(logs.schema).parquet(source), services=["a"])
    out = scratch("json")
    drain(stream.select("record"), out)
    assert [json.loads(r.record)["service"] for r in spark.read.parquet(f"{out}/rows").collect()] == ["a"]


def test_stateful_limits_span_micro_batches(spark, scratch, make_logs):
    rows = [{"time_ns": NOW + i * 7 * SECOND, "service": "ab"[i % 2]} for i in range(60)]
    logs = make_logs(rows).select("service", "time_ns", "ingest_ns", "record_id").cache()
    source = scratch("source")
    for part in range(3):
        chunk = logs.where(F.floor((F.col("time_ns") - NOW) / (140 * SECOND)) == part)
        chunk.coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(source)

    spaced, limited = scratch("spaced"), scratch("limited")
    drain(throttle_stream(stream(), "service", 40 * SECOND), spaced)
    wanted = throttle(logs, ["service"], 40 * SECOND)
    assert sorted(spark.read.parquet(f"{spaced}/rows").collect()) == sorted(wanted.collect())
    drain(rate_limit_stream(stream(), "service", per_minute=3), limited)
    wanted = rate_limit(logs, "service", per_minute=3)
    assert sorted(spark.read.parquet(f"{limited}/rows").collect()) == sorted(wanted.collect())


def test_future_stamps_hurt_no_other_row(spark, scratch, make_logs):
    """One row ten years ahead, in the first micro-batch of three."""
    ahead = {"time_ns": NOW + 3650 * 24 * HOUR, "ingest_ns": NOW, "service": "a"}
    batches = [[ahead], [{"time_ns": NOW + i, "service": "a"} for i in range(3)], [{"time_ns": NOW + 9 + i, "service": "a"} for i in range(3)]]
    source, counts, limited = scratch("source"), scratch("counts"), scratch("limited")
    for rows in batches:
        logs = make_logs(rows).select("service", "severity", "time_ns", "ingest_ns", "record_id")
        logs.coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(source)

    write_counts(stream(), hourly_counts, f"{counts}/rows", f"{counts}/checkpoint").awaitTermination()
    summed = read_counts(spark, f"{counts}/rows", ["hour_ns", "service", "severity"], ["count"])
    assert sorted(r["count"] for r in summed.collect()) == [1, 6]
    drain(rate_limit_stream(stream(), "service", per_minute=1), limited)
    assert spark.read.parquet(f"{limited}/rows").count() == 2


def test_counts_of_several_checkpoints_replays_and_merges(spark, scratch, make_logs):
    """Two queries on one path, a replayed update, merges by hand and of themselves, a merge that died."""
    keys, values = ["hour_ns", "service", "severity"], ["count"]
    source, counts = scratch("source"), scratch("counts")
    logs = make_logs([{"time_ns": NOW + i * HOUR // 3, "service": "ab"[i % 2]} for i in range(12)]).select("service", "severity", "time_ns")
    for part in range(4):
        logs.where(F.floor((F.col("time_ns") - NOW) / HOUR) == part).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint, **options):
        stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        write_counts(stream, hourly_counts, f"{counts}/rows", f"{counts}/{checkpoint}", **options).awaitTermination()

    def summed():
        return sorted(map(tuple, read_counts(spark, f"{counts}/rows", keys, values).collect()))

    def times(n):
        return sorted((*row[:3], row[3] * n) for row in hourly_counts(logs).collect())

    run("first")
    assert summed() == times(1)
    merge_counts(spark, f"{counts}/rows", keys, values)
    assert summed() == times(1)
    run("second")
    assert summed() == times(2)
    deltas = spark.read.parquet(f"{counts}/rows/deltas")
    query = deltas.select("query").first()[0]
    replayed = deltas.where("update = 1").drop("query", "update").collect()
    # a merge that died before its manifest, then one that is complete; then the replay of a merged update
    spark.createDataFrame(replayed, deltas.drop("query", "update").schema).write.parquet(f"{counts}/rows/merged/generation=1")
    assert summed() == times(2)
    merge_counts(spark, f"{counts}/rows", keys, values)
    spark.createDataFrame(replayed, deltas.drop("query", "update").schema).write.parquet(f"{counts}/rows/deltas/query={query}/update=1")
    assert summed() == times(2)
    run("third", keys=keys, merge_every=2)
    assert summed() == times(3)
    kept = {tuple(part for part in os.path.relpath(folder, f"{counts}/rows").split("/")) for folder, _, files in os.walk(f"{counts}/rows") if files}
    assert len(kept) == 2 and {path[0] for path in kept} == {"merged", "manifest"}
