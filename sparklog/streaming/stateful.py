"""Per-key limits that remember earlier micro-batches.

State is one number per key, or one per key and recent minute. A micro-batch's rows of one key are sorted in one task,
so bound the micro-batch (maxFilesPerTrigger, maxBytesPerTrigger) where a key may flood.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

from sparklog.schema import MAX_RECORD_AGE_NS, NS_PER_SECOND, RATE_LIMIT_PER_MINUTE, THROTTLE_GAP_NS


def throttle_stream(stream: DataFrame, key: str, gap_ns: int = THROTTLE_GAP_NS) -> DataFrame:
    """As ``throttle`` for one key column; the last kept time lives in the state."""

    def keep_spaced(group, frames, state):
        rows = pd.concat(list(frames)).sort_values(["time_ns", "record_id"], kind="stable")
        last = state.get[0] if state.exists else None
        kept = []
        for at in rows["time_ns"].tolist():
            due = last is None or at - last >= gap_ns
            kept.append(due)
            last = at if due else last
        state.update((last,))
        yield rows[kept]

    return stream.groupBy(key).applyInPandasWithState(
        keep_spaced, stream.schema, "last_ns long", "append", "NoTimeout"
    )


def rate_limit_stream(stream: DataFrame, key: str, per_minute: int = RATE_LIMIT_PER_MINUTE) -> DataFrame:
    """At most ``per_minute`` rows per key and clock minute, counted across micro-batches.

    The state holds the counts of the minutes from 24 hours before the newest ``ingest_ns`` on:
    what is older was refused as too old at ingest. No watermark and no timeout, and a fast
    client clock, which ingest time does not follow, forgets no minute.
    """
    minute_ns = 60 * NS_PER_SECOND
    kept_minutes = MAX_RECORD_AGE_NS // minute_ns

    def keep_first(group, frames, state):
        rows = pd.concat(list(frames)).sort_values(["time_ns", "record_id"], kind="stable")
        used = {int(m): n for m, n in json.loads(state.get[0]).items()} if state.exists else {}
        newest = max(int(rows["ingest_ns"].max()), state.get[1] if state.exists else 0)
        minute = rows["time_ns"] // minute_ns
        place = minute.map(used).fillna(0) + rows.groupby(minute).cumcount()
        for number, count in minute.value_counts().items():
            used[int(number)] = used.get(int(number), 0) + int(count)
        oldest = newest // minute_ns - kept_minutes
        state.update((json.dumps({m: n for m, n in used.items() if m >= oldest}), newest))
        yield rows[place < per_minute]

    return stream.groupBy(key).applyInPandasWithState(
        keep_first, stream.schema, "used string, newest_ns long", "append", "NoTimeout"
    )
