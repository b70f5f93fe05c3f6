from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklog.schema import NS_PER_DAY, NS_PER_HOUR, NS_PER_SECOND

# The viewer's time presets.
PRESETS = {
    "15m": 15 * 60 * NS_PER_SECOND,
    "1h": NS_PER_HOUR,
    "6h": 6 * NS_PER_HOUR,
    "24h": NS_PER_DAY,
    "7d": 7 * NS_PER_DAY,
}

_RFC3339 = re.compile(
    r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9})\d*)?(?:Z|([+-])(\d\d):(\d\d))"
)
_EPOCH = dt.datetime(1970, 1, 1)


def floor_div(value: Column, unit: int) -> Column:
    """Integer floor division (rounds down for negatives, never through DOUBLE)."""
    whole = F.call_function("div", value, F.lit(unit).cast("long"))
    return whole - F.when((value < 0) & (value % unit != 0), 1).otherwise(0)


def utc_day(time_ns: Column) -> Column:
    """UTC calendar day; does not depend on the session time zone."""
    return F.date_from_unix_date(floor_div(time_ns, NS_PER_DAY).cast("int"))


def event_time(time_ns: Column) -> Column:
    """TIMESTAMP at microsecond resolution, for windows only."""
    return F.timestamp_micros(floor_div(time_ns, 1000))


def rfc3339_nano(time_ns: Column) -> Column:
    """UTC RFC 3339 text with up to nine fraction digits, trailing zeros trimmed."""
    second = F.pmod(floor_div(time_ns, NS_PER_SECOND), F.lit(86400))

    def two(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    clock = F.concat_ws(
        ":",
        two(F.call_function("div", second, F.lit(3600))),
        two(F.call_function("div", second % 3600, F.lit(60))),
        two(second % 60),
    )
    nanos = F.pmod(time_ns, F.lit(NS_PER_SECOND))
    fraction = F.rtrim(F.lpad(nanos.cast("string"), 9, "0"), F.lit("0"))
    return F.concat(
        utc_day(time_ns).cast("string"),
        F.lit("T"),
        clock,
        F.when(nanos == 0, "").otherwise(F.concat(F.lit("."), fraction)),
        F.lit("Z"),
    )


def to_ns(value: int | str | dt.datetime | None, now_ns: int | None = None) -> int | None:
    """A query bound as integer nanoseconds.

    Takes nanoseconds, an aware datetime, RFC 3339 text, or a preset name ("15m", "1h",
    "6h", "24h", "7d") counted back from ``now_ns``. Nothing else parses.
    """
    if value is None or isinstance(value, int):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            raise ValueError("datetime bounds need a time zone")
        naive = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return ((naive - _EPOCH) // dt.timedelta(microseconds=1)) * 1000
    if value in PRESETS:
        if now_ns is None:
            raise ValueError(f"preset {value!r} needs now_ns")
        return now_ns - PRESETS[value]
    found = _RFC3339.fullmatch(value)
    if not found:
        raise ValueError(f"{value!r} is not RFC 3339, e.g. 2026-04-13T12:00:00Z")
    parts = [int(x) for x in found.groups()[:6]]
    seconds = (dt.datetime(*parts) - _EPOCH) // dt.timedelta(seconds=1)
    if found[8]:
        shift = int(found[9]) * 3600 + int(found[10]) * 60
        seconds += -shift if found[8] == "+" else shift
    return seconds * NS_PER_SECOND + int((found[7] or "0").ljust(9, "0"))
