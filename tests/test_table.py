from __future__ import annotations

import datetime as dt

import pytest
from log_fixtures import HOUR, NOW
from pyspark.sql import functions as F

from sparklog.operators.query import filter_logs, query_logs
from sparklog.operators.rollup import write_rollup
from sparklog.operators.stored import stored_newest
from sparklog.operators.summary import partition_info, summary
from sparklog.plans.rollup_routing import summary_from_rollup
from sparklog.sources import log_table as store

DAY = 24 * HOUR


def days(spark, table):
    return [str(r.day) for r in store.partition_days(spark, table).collect()]


def test_days_listed_in_order(spark, log_table, make_logs):
    assert days(spark, log_table) == []
    for batch, shift in enumerate((2, 0, 1)):
        store.write_batch(make_logs([{"time_ns": NOW + shift * DAY}]), log_table, "r", batch)
    assert days(spark, log_table) == ["2026-04-13", "2026-04-14", "2026-04-15"]


def test_round_trip_keeps_every_field(spark, log_table, make_logs):
    full = {
        "severity": 13,
        "version": "1",
        "logger": "l",
        "trace_id": b"\x01" * 16,
        "span_id": b"\x02" * 8,
        "attrs_json": '{"a":1}',
        "exception": ("t", "m", None),
        "ingest_ns": NOW + 100,
    }
    logs = make_logs([full, {}])
    store.write_batch(logs, log_table, "r", 0)
    stored = store.read_logs(spark, log_table)
    assert sorted(stored.collect()) == sorted(logs.select(*stored.columns).collect())


def test_replay_changes_nothing(spark, log_table, make_logs):
    first, second = make_logs([{}] * 3), make_logs([{"record_id": "other"}])
    for _ in range(2):
        store.write_batch(first, log_table, "r", 0)
        store.write_batch(second, log_table, "r", 1)
    info = partition_info(store.read_logs(spark, log_table)).first()
    assert (info.row_count, info.last_ingest_ns) == (4, NOW)


def test_day_pruning_reaches_the_scan(spark, log_table, make_logs):
    store.write_batch(make_logs([{"time_ns": NOW + d * DAY} for d in range(4)]), log_table, "r", 0)
    found = filter_logs(store.read_logs(spark, log_table), since=NOW + DAY, until=NOW + 2 * DAY)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "day" in filters and "2026-04-14" in filters and "2026-04-15" in filters
    assert found.count() == 1


def test_drop_days(spark, log_table, make_logs):
    store.write_batch(make_logs([{"time_ns": NOW + d * DAY} for d in range(3)]), log_table, "r", 0)
    assert store.drop_days(spark, log_table, ["2026-04-14", "1999-01-01"]) == ["2026-04-14"]
    assert store.drop_days(spark, log_table, ["2026-04-14"]) == []
    assert days(spark, log_table) == ["2026-04-13", "2026-04-15"]
    with pytest.raises(ValueError):
        store.drop_days(spark, log_table, ["not-a-day"])


def test_retention(spark, log_table, make_logs):
    store.write_batch(make_logs([{"time_ns": NOW - d * DAY} for d in range(10)]), log_table, "r", 0)
    assert len(store.retain(spark, log_table, NOW, 7)) == 2
    assert days(spark, log_table)[0] == "2026-04-06"
    with pytest.raises(ValueError):
        store.retain(spark, log_table, NOW, 0)


def test_archive(spark, log_table, make_logs, scratch):
    store.write_batch(make_logs([{"time_ns": NOW - d * DAY} for d in range(3)]), log_table, "r", 0)
    path = scratch("archive")
    store.archive(spark, log_table, path, ["2026-04-11"])
    assert days(spark, log_table) == ["2026-04-12", "2026-04-13"]
    assert spark.read.parquet(path).count() == 1


def test_late_rows_do_not_replace_an_archive(spark, log_table, make_logs, scratch):
    path = scratch("archive")
    store.write_batch(make_logs([{"record_id": str(i)} for i in range(5)]), log_table, "r", 0)
    store.archive(spark, log_table, path, ["2026-04-13"], drop=False)
    store.archive(spark, log_table, path, ["2026-04-13"])
    assert spark.read.parquet(path).count() == 5 and spark.table(log_table).count() == 0
    store.write_batch(make_logs([{"record_id": "late"}]), log_table, "r", 1)
    store.archive(spark, log_table, path, ["2026-04-13"])
    assert spark.read.parquet(path).count() == 6


def test_archive_through_crash_and_compaction(spark, log_table, make_logs, scratch, monkeypatch):
    """Each id is archived once: copies without drop, a copy that died, one that died before the drop."""
    path, day = scratch("archive"), "2026-04-13"

    def write(batch):
        store.write_batch(make_logs([{"record_id": f"{batch}-{i}"} for i in range(3)]), log_table, "r", batch)

    def archived():
        return ids(store.read_archive(spark, path))

    assert archived() == []
    write(0)
    store.archive(spark, log_table, path, [day], drop=False)
    write(1)
    with monkeypatch.context() as patched:
        patched.setattr(store, "manifest_path", dying(2)(store.manifest_path))
        with pytest.raises(Died):  # the copy is written and not recorded
            store.archive(spark, log_table, path, [day])
    assert spark.read.parquet(path).count() == 6 and len(archived()) == 3
    store.compact_day(spark, log_table, day)
    with monkeypatch.context() as patched:
        patched.setattr(store, "_drop", dying(1)(store._drop))
        with pytest.raises(Died):
            store.archive(spark, log_table, path, [day])
    assert archived() == [f"{b}-{i}" for b in range(2) for i in range(3)]
    write(2)
    store.compact_day(spark, log_table, day)
    store.archive(spark, log_table, path, [day])
    assert archived() == [f"{b}-{i}" for b in range(3) for i in range(3)]
    assert spark.table(log_table).count() == 0
    write(1)  # a replay of what is archived
    store.archive(spark, log_table, path, [day])
    assert len(archived()) == 9


def test_newest_reads_only_the_days_it_needs(spark, log_table, make_logs):
    rows = [{"record_id": f"{d}-{i}", "time_ns": NOW - d * DAY + i, "service": "ab"[d % 2]} for d in range(6) for i in range(4)]
    store.write_batch(make_logs(rows), log_table, "r", 0)

    def read_days(found):
        filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
        return [d for d in ("2026-04-13", "2026-04-12", "2026-04-10") if f">= {d}" in filters or f">= {(dt.date.fromisoformat(d) - dt.date(1970, 1, 1)).days}" in filters]

    for limit, options, day in [(3, {}, "2026-04-13"), (6, {}, "2026-04-12"), (3, {"services": ["b"]}, "2026-04-12"), (100, {}, None)]:
        found = stored_newest(spark, log_table, limit, **options)
        wanted = query_logs(store.read_logs(spark, log_table), limit, **options)
        assert found.collect() == wanted.collect()
        assert read_days(found) == ([day] if day else [])
    bounded = stored_newest(spark, log_table, 2, since=NOW - 3 * DAY, until=NOW - 2 * DAY + 1)
    assert [r.record_id for r in bounded.collect()] == ["2-0", "3-3"]


def test_batches_add_up_in_a_plain_session(spark, log_table, make_logs):
    key = "spark.sql.sources.partitionOverwriteMode"
    spark.conf.set(key, "static")
    try:
        store.write_batch(make_logs([{"record_id": str(i)} for i in range(3)]), log_table, "r", 0)
        store.write_batch(make_logs([{"record_id": "3"}, {"record_id": "4"}]), log_table, "r", 1)
        assert spark.table(log_table).count() == 5
        store.compact_day(spark, log_table, "2026-04-13")
        assert spark.table(log_table).count() == 5 and spark.conf.get(key) == "static"
    finally:
        spark.conf.set(key, "dynamic")


def test_compaction(spark, log_table, make_logs):
    for batch in range(3):
        rows = [{"record_id": f"{batch}-{i}", "service": "ab"[i % 2]} for i in range(5)]
        store.write_batch(make_logs(rows), log_table, "r", batch)
    store.compact_day(spark, log_table, "2026-04-13")
    stored = spark.table(log_table)
    assert stored.count() == 15 and stored.select("record_id").distinct().count() == 15
    assert [tuple(r) for r in stored.select("run_id", "batch_id").distinct().collect()] == [("compacted", 0)]
    store.write_batch(make_logs([{"record_id": "late"}]), log_table, "r", 9)
    store.compact_day(spark, log_table, "2026-04-13")
    assert spark.table(log_table).count() == 16


class Died(Exception):
    pass


def dying(at):
    """A step that stops the run when it is called for the `at`-th time."""
    calls = []

    def step(wanted):
        def run(*args):
            calls.append(args)
            if len(calls) == at:
                raise Died
            return wanted(*args)

        return run

    return step


def ids(rows):
    return sorted(r.record_id for r in rows.collect())


@pytest.mark.parametrize(("step", "at"), [("_note", 1), ("_note", 2), ("finish_compaction", 2)])
def test_compaction_that_died_shows_every_row_once(spark, log_table, make_logs, monkeypatch, step, at):
    """It died before the merge, after it with the sources still shown, and with the merged files shown."""
    for batch in range(3):
        store.write_batch(make_logs([{"record_id": f"{batch}"}]), log_table, "r", batch)
    with monkeypatch.context() as patched:
        patched.setattr(store, step, dying(at)(getattr(store, step)))
        with pytest.raises(Died):
            store.compact_day(spark, log_table, "2026-04-13")
        assert ids(store.read_logs(spark, log_table)) == ["0", "1", "2"]
    store.write_batch(make_logs([{"record_id": "late"}]), log_table, "r", 7)
    assert ids(store.read_logs(spark, log_table)) == ["0", "1", "2", "late"]
    store.compact_day(spark, log_table, "2026-04-13")
    assert ids(store.read_logs(spark, log_table)) == ids(spark.table(log_table)) == ["0", "1", "2", "late"]
    assert len(store._partitions(spark, log_table)) == 1


def test_compaction_that_died_while_dropping(spark, log_table, make_logs, monkeypatch):
    for batch in range(3):
        store.write_batch(make_logs([{"record_id": f"{batch}"}]), log_table, "r", batch)
    with monkeypatch.context() as patched:
        patched.setattr(store, "DROPPED_AT_ONCE", 1)
        whole = spark.sql

        def dies(text, *args):
            if "DROP IF EXISTS" in text and "batch_id=1)" in text:
                raise Died
            return whole(text, *args)

        patched.setattr(spark, "sql", dies)
        with pytest.raises(Died):
            store.compact_day(spark, log_table, "2026-04-13")
    assert len(store._partitions(spark, log_table)) == 3
    assert ids(store.read_logs(spark, log_table)) == ["0", "1", "2"]
    store.finish_compaction(spark, log_table, "2026-04-13")
    assert ids(spark.table(log_table)) == ["0", "1", "2"]


def test_replay_of_a_compacted_batch(spark, log_table, make_logs):
    batches = [make_logs([{"record_id": f"{batch}"}]) for batch in range(2)]
    for _ in range(2):
        for batch, rows in enumerate(batches):
            store.write_batch(rows, log_table, "r", batch)
        store.compact_day(spark, log_table, "2026-04-13")
    assert ids(spark.table(log_table)) == ["0", "1"]


def test_batch_that_died_before_its_commit_is_written_again(spark, log_table, make_logs, monkeypatch):
    with monkeypatch.context() as patched:
        patched.setattr(store, "_commit", dying(1)(store._commit))
        with pytest.raises(Died):
            store.write_batch(make_logs([{"record_id": "half"}]), log_table, "r", 0)
    store.write_batch(make_logs([{"record_id": "a"}, {"record_id": "b"}]), log_table, "r", 0)
    assert ids(spark.table(log_table)) == ["a", "b"]
    with pytest.raises(ValueError, match="run_id"):
        store.write_batch(make_logs([{}]), log_table, "r/1", 0)


def test_stored_bytes(spark, log_table, make_logs):
    store.write_batch(make_logs([{}]), log_table, "r", 0)
    size = store.partition_bytes(spark, log_table).first()
    assert (size.day, size.files) == (dt.date(2026, 4, 13), 1) and size.byte_size > 0
    assert store.over_limit_days(spark, log_table, size.byte_size).count() == 0
    assert store.over_limit_days(spark, log_table, size.byte_size - 1).count() == 1


def test_summary_by_rollup_equals_summary(spark, make_logs, scratch):
    logs = make_logs(
        [{"time_ns": NOW + i * HOUR // 7, "service": "ab"[i % 2], "severity": 5 + 4 * (i % 4)} for i in range(200)]
    ).cache()
    path = scratch("rollup")
    write_rollup(logs, path)
    rollup = spark.read.parquet(path)
    edges = [None, NOW, NOW + 1, NOW + 5 * HOUR + 17, NOW + 6 * HOUR - 1, NOW + 30 * HOUR]
    for since in edges[:4]:
        for until in edges[2:] + [None]:
            wanted = summary(logs, since=since, until=until)
            got = summary_from_rollup(rollup, logs, since, until)
            assert sorted(got.collect()) == sorted(wanted.collect())
    both = summary_from_rollup(rollup, logs, group_by=("service",))
    assert both.agg(F.sum("count")).first()[0] == 200
