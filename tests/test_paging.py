"""Pages by cursor, and the cap of whole records."""

from __future__ import annotations

import json

import pytest
from log_fixtures import NOW
from pyspark.sql import functions as F

from sparklog.functions.tokens import term
from sparklog.operators.paging import following_pages, page_logs
from sparklog.operators.safety import cap_whole_record, record_bytes


def walk(logs, limit, **filters):
    pages, cursor = [], None
    while True:
        page = page_logs(logs, limit, cursor, **filters)
        pages.append([(r.time_ns, r.record_id) for r in page.rows.collect()])
        cursor = page.next_cursor
        if cursor is None:
            return pages


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 100])
def test_pages_show_every_copy_once(make_logs, limit):
    """Equal times, equal ids at equal times, and groups of copies longer than a page."""
    keys = [(NOW + i % 3, f"r{i % 4}") for i in range(10)] + [(NOW + 1, "same")] * 5 + [(NOW - 9, "last")] * 2
    logs = make_logs([{"time_ns": t, "record_id": r} for t, r in keys]).cache()
    pages = walk(logs, limit)
    assert [row for page in pages for row in page] == sorted(keys, key=lambda k: (-k[0], k[1]))
    assert all(len(page) == limit for page in pages[:-1])


@pytest.mark.parametrize("limit", [1, 3, 7, 100])
def test_following_pages_are_the_pages_one_by_one(make_logs, limit):
    """All pages and cursors in one pass, from the start and from a cursor within a group of copies."""
    keys = [(NOW + i % 3, f"r{i % 4}é") for i in range(10)] + [(NOW + 1, "same")] * 5 + [(NOW - 9, "last")] * 2
    logs = make_logs([{"time_ns": t, "record_id": r, "severity": 17} for t, r in keys]).cache()
    for start in (None, page_logs(logs, 5, min_severity="ERROR").next_cursor):
        rows, ends = following_pages(logs, limit, start, min_severity="ERROR")
        found, cursors = {}, {r.page: r.next_cursor for r in ends.collect()}
        for r in rows.orderBy("page", F.desc("time_ns"), "record_id").collect():
            found.setdefault(r.page, []).append((r.time_ns, r.record_id))
        for number in range(len(found) + 1):
            page = page_logs(logs, limit, cursors[number - 1] if number else start, min_severity="ERROR")
            assert [(r.time_ns, r.record_id) for r in page.rows.collect()] == found.get(number, [])
            assert (page.next_cursor is None) == (number not in cursors)
            if page.next_cursor is None:
                break
        assert sum(map(len, found.values())) == (17 if start is None else 12)


def test_walk_takes_no_job_for_each_page(spark, tmp_path):
    """The registered walk runs equally many jobs over 3 pages and over 30."""
    from sparklog.plans.reads import pages_join_up

    def jobs(n: int) -> int:
        folder = tmp_path / str(n)
        rows = spark.range(n).selectExpr(
            "id AS event_id", "timestamp_seconds(1705000000 + id) AS ts", "id % 50 * 5 + 1 AS user_id",
            "'error' AS event_type", "CAST(id AS DOUBLE) AS value", "'{\"k\": 1}' AS props",
        )
        rows.write.parquet(str(folder / "events.parquet"))
        group = f"walk-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert pages_join_up(spark, str(folder)).agg(F.sum("copies")).first()[0] == n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(30_000) <= jobs(3_000) + 10


def test_newer_rows_and_filters(make_logs):
    old = make_logs([{"time_ns": NOW + i, "record_id": str(i), "service": "ab"[i % 2], "message": "hit"} for i in range(8)])
    first = page_logs(old, 2, services=["a"], text=term("hit"))
    more = old.unionByName(make_logs([{"time_ns": NOW + 99, "record_id": "new", "service": "a", "message": "hit"}]))
    second = page_logs(more, 2, first.next_cursor, services=["a"], text=term("hit"))
    assert [r.record_id for p in (first, second) for r in p.rows.collect()] == ["6", "4", "2", "0"]
    assert page_logs(more, 2, second.next_cursor, services=["a"], text=term("hit")).rows.count() == 0
    for filters in ({"services": ["b"], "text": term("hit")}, {"services": ["a"]}, {"services": ["a"], "text": term("other")}):
        with pytest.raises(ValueError, match="other filters"):
            page_logs(more, 2, first.next_cursor, **filters)
    for broken in ("", "x", "!!", first.next_cursor[:-4], "bnVsbA"):
        with pytest.raises(ValueError, match="not a cursor"):
            page_logs(more, 2, broken)


def test_record_cap(make_logs):
    big = "é" * 1_500_000
    rows = [
        {"record_id": "stack", "exception": ("T", "m", big)},
        {"record_id": "attrs", "attrs_json": json.dumps({"long": big, "nested": {"k": [big]}, "n": 5}, ensure_ascii=False)},
        {"record_id": "all", "message": big, "exception": (big, big, big), "attrs_json": json.dumps({"q": '"\\\n' * 50_000})},
        {"record_id": "keys", "attrs_json": json.dumps({f"key{i}": i for i in range(20_000)})},
        {"record_id": "control", "attrs_json": json.dumps({"c": "\u0001" * 100_000, "b": 1})},
        {"record_id": "exact", "message": "x" * 65_536},
        {"record_id": "small", "attrs_json": '{"a":1}'},
    ]
    logs = make_logs(rows)
    capped = cap_whole_record(logs)
    assert capped.columns == logs.columns
    found = {r.record_id: r for r in capped.withColumn("bytes", record_bytes(capped)).collect()}
    before = {r.record_id: r for r in logs.withColumn("bytes", record_bytes(logs)).collect()}
    for name in ("exact", "small"):
        assert found[name] == before[name]
    for name in ("stack", "attrs", "all", "keys", "control"):
        assert found[name].bytes <= 65_536 and json.loads(found[name].attrs_json)["truncated"] is True
    assert found["stack"].bytes > 65_000 and big.startswith(found["stack"].exception.stacktrace) and found["stack"].exception.type == "T"
    attrs = json.loads(found["attrs"].attrs_json)
    assert attrs["n"] == 5 and big.startswith(attrs["long"]) and attrs["nested"].startswith('{"k":["é') and found["attrs"].bytes > 40_000
    assert json.loads(found["keys"].attrs_json) == {"truncated": True}
    assert found["all"].message and found["all"].exception.stacktrace
    assert cap_whole_record(logs.where(F.lit(False))).count() == 0
