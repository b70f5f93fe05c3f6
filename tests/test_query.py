from __future__ import annotations

import json

import pytest
from log_fixtures import HOUR, NOW, SECOND
from pyspark.sql import functions as F

from sparklog.functions.tokens import term
from sparklog.operators import query as q
from sparklog.operators.correlate import correlate
from sparklog.operators.safety import cap_record_size, disk_guard, pin_service, rate_limit
from sparklog.operators.search import search_logs
from sparklog.operators.summary import introspect, summary
from sparklog.operators.throttle import _next_kept, throttle
from sparklog.sources.driver_tables import logs_from_events

MINUTE = 60 * SECOND


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_empty_table(make_logs):
    empty = make_logs([{}]).where("false")
    assert q.query_logs(empty).collect() == []


def test_newest_first(make_logs):
    logs = make_logs([{"time_ns": NOW + i * MINUTE} for i in (1, 0, 2)])
    assert [r.time_ns for r in q.query_logs(logs).collect()] == [NOW + i * MINUTE for i in (2, 1, 0)]


def test_services(make_logs):
    logs = make_logs([{"service": s} for s in ("a", "b", "c", "")])
    assert q.query_logs(logs, services=["a", "c"]).count() == 2
    assert q.query_logs(logs, services=[]).count() == 4
    assert [r.service for r in q.query_logs(logs, services=[""]).collect()] == [""]


def test_min_severity(make_logs):
    logs = make_logs([{"severity": n} for n in (5, 9, 13, 17)])
    for floor, rows in (("WARN", 2), ("warning", 2), (17, 1), ("17", 1), (0, 4), (-2, 4), (None, 4)):
        assert q.query_logs(logs, min_severity=floor).count() == rows


def test_half_open_range(make_logs):
    logs = make_logs([{"time_ns": NOW + i * MINUTE} for i in range(5)])
    assert q.query_logs(logs, since=NOW + MINUTE, until=NOW + 4 * MINUTE).count() == 3


def test_limits(make_logs):
    logs = make_logs([{"time_ns": NOW + i} for i in range(1100)])
    sizes = [q.query_logs(logs, limit=n).count() for n in (None, 0, 5, 99_999)]
    assert sizes == [100, 100, 5, 1000]
    assert q.query_logs(logs, limit=None, clamp=False).count() == 1100
    with pytest.raises(ValueError):
        q.query_logs(logs, limit=-1)


def test_two_days(make_logs):
    midnight = NOW + 12 * HOUR
    logs = make_logs([{"time_ns": midnight - HOUR}, {"time_ns": midnight + HOUR}])
    assert q.query_logs(logs).select("day").distinct().count() == 2
    assert q.query_logs(logs, since=midnight).count() == 1


def test_pages_join_up_to_the_whole(make_logs):
    logs = make_logs([{"time_ns": NOW + i // 7} for i in range(60)])
    whole = [r.record_id for r in q.query_logs(logs, limit=1000).collect()]
    paged, after = [], None
    while page := q.query_logs(logs, limit=11, after=after).collect():
        paged += [r.record_id for r in page]
        after = (page[-1].time_ns, page[-1].record_id)
    assert paged == whole


def test_json_shape(make_logs):
    logs = make_logs([{"severity": 13, "instance": "", "version": None, "message": ""}])
    record = json.loads(q.to_json_records(logs).first().record)
    assert record == {
        "time": "2026-04-13T12:00:00Z",
        "ingest": "2026-04-13T12:00:00Z",
        "severity": "WARN",
        "service": "x",
        "message": "",
    }


def test_attribute_with_dots_and_types(make_logs):
    logs = make_logs([{"attrs_json": '{"http.status":500,"a\'b":"x"}'}, {"attrs_json": None}, {"attrs_json": "junk"}])
    assert q.query_logs(logs, attributes={"http.status": "500"}).count() == 1
    assert q.query_logs(logs, attributes={"a'b": "x"}).count() == 1
    assert q.query_logs(logs, attributes={"http": "500"}).count() == 0


def test_correlate_in_time_order(make_logs):
    one, two = b"\x01" * 16, b"\x02" * 16
    logs = make_logs([{"trace_id": t, "time_ns": NOW - i} for i, t in enumerate([one, two, None, one])])
    assert [r.time_ns for r in correlate(logs, one.hex()).collect()] == [NOW - 3, NOW]
    assert correlate(logs, logs.where("time_ns < %d" % (NOW - 1))).count() == 2


def test_search_with_filters(make_logs):
    logs = make_logs([{"message": "upload worker disconnected"}, {"message": "worker", "severity": 17}, {}])
    assert search_logs(logs, term("worker")).count() == 2
    assert search_logs(logs, term("worker"), min_severity="ERROR").count() == 1


def test_summary_by_attribute(make_logs):
    logs = make_logs([{"attrs_json": '{"a.b":1}'}, {"attrs_json": '{"a.b":1}'}, {}])
    assert {(r[0], r[1]) for r in summary(logs, ("attr.a.b",)).collect()} == {("1", 2), (None, 1)}


def test_introspection_skips_what_is_absent(make_logs):
    logs = make_logs([{"logger": "l", "attrs_json": '{"k":1}'}, {"service": "y"}])
    found = {(r.field, r.value) for r in introspect(logs).collect()}
    assert found == {("service", "x"), ("service", "y"), ("logger", "l"), ("severity", "INFO"), ("attribute_key", "k")}


def test_count_stops_at_the_cap(make_logs):
    assert q.count_capped(make_logs([{}] * 7), 5).first().count_total_estimate == 5


def test_size_cap_marks_the_record(make_logs):
    rows = cap_record_size(make_logs([{"message": "é" * 50, "attrs_json": '{"z":1}'}, {"message": "ok"}]), 63)
    cut, whole = rows.orderBy("record_id").collect()
    assert (cut.message, json.loads(cut.attrs_json)) == ("é" * 31, {"z": 1, "truncated": True})
    assert (whole.message, whole.attrs_json) == ("ok", None)


def test_pinned_service(spark, make_logs):
    keys = spark.createDataFrame([("k1", "ios")], "ingest_key string, service string")
    logs = make_logs([{"service": "forged"}, {"service": "own"}])
    logs = logs.withColumn("ingest_key", F.when(F.col("service") == "forged", "k1"))
    assert {r.service for r in pin_service(logs, keys).collect()} == {"ios", "own"}


def test_disk_guard(make_logs):
    logs = make_logs([{"severity": s, "time_ns": NOW + d * 24 * HOUR} for s in (1, 5, 9, 17) for d in (0, 1)])
    sizes = logs.select("day").distinct().withColumn("byte_size", F.dayofmonth("day"))
    assert disk_guard(logs, sizes, limit=13).groupBy("day").count().orderBy("day").collect()[1]["count"] == 2
    assert disk_guard(logs, sizes, limit=14).count() == 8


def test_rate_limit_counts_each_minute(make_logs):
    logs = make_logs([{"time_ns": NOW + i * 10 * SECOND, "service": s} for i in range(12) for s in "ab"])
    kept = rate_limit(logs, "service", per_minute=4)
    assert kept.count() == 16 and set(kept.columns) == set(logs.columns)


def test_rate_limit_is_cut_before_the_shuffle(make_logs):
    assert plan(rate_limit(make_logs([{}]), "service")).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("fold_rows", [40, 10_000])
@pytest.mark.parametrize("gap", [7, 500])
def test_throttle_equals_brute_force(make_logs, gap, fold_rows):
    import random

    rnd = random.Random(gap)
    rows = [{"service": s, "time_ns": rnd.randrange(6000)} for s, n in (("hot", 900), ("cold", 30)) for _ in range(n)]
    rows += [{"service": "steady", "time_ns": 5 * i} for i in range(300)]
    logs = make_logs(rows)
    last, wanted = {}, set()
    order = sorted((r["service"], r["time_ns"], f"r{i:06d}") for i, r in enumerate(rows))
    for service, at, record in order:
        if service not in last or at - last[service] >= gap:
            last[service] = at
            wanted.add(record)
    kept = throttle(logs, ["service"], gap, fold_rows)
    assert {r.record_id for r in kept.collect()} == wanted


@pytest.mark.parametrize("fold_rows", [1, 100])
def test_throttle_keeps_rows_without_key(make_logs, fold_rows):
    logs = make_logs([{"logger": name, "time_ns": NOW + i} for name in (None, "a") for i in range(4)])
    assert throttle(logs, ["logger"], 2, fold_rows).count() == 4


@pytest.mark.parametrize("fold_rows", [1, 100])
def test_throttle_with_no_gap_keeps_all(make_logs, fold_rows):
    assert throttle(make_logs([{}, {}, {"time_ns": NOW + 1}]), ["service"], 0, fold_rows).count() == 3


def test_throttle_with_an_outlier_slices_by_rows(spark, make_logs):
    """One row years ahead: what is kept is the same for every ``fold_rows``, and no slice holds most rows."""
    logs = make_logs([{"time_ns": NOW + i * SECOND} for i in range(600)] + [{"time_ns": NOW + 10**17}])
    kept = {n: sorted(r.record_id for r in throttle(logs, ["service"], 7 * SECOND, n).collect()) for n in (20, 100, 1000)}
    assert kept[20] == kept[100] == kept[1000] and len(kept[20]) == 87
    instants = logs.select("service", "time_ns", "record_id").withColumn("first_ns", F.lit(NOW))
    seen = instants.select("service", F.col("time_ns").alias("at")).repartitionByRange(12, "service", "at")
    assert seen.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
    assert _next_kept(instants, ["service"], 7 * SECOND, 6).count() == 600


def test_throttle_with_one_slot(make_logs):
    logs = make_logs([{"time_ns": NOW + i * 30 * SECOND, "service": str(i)} for i in range(5)])
    assert throttle(logs).count() == 3


def test_plans(spark, make_logs):
    logs = logs_from_events(spark, "/root/testdata/sf0.001")
    top = plan(q.query_logs(logs, since="2024-01-05T00:00:00Z", until="2024-01-06T00:00:00Z"))
    assert "TakeOrderedAndProject" in top and "Exchange" not in top
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in top
    counted = plan(summary(logs))
    assert "partial_count" in counted and "value" not in counted.split("ReadSchema")[1]
