from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklog.schema import MAX_RECORD_BYTES, PREVIEW_CHARS

ANSI_ESCAPE = r"\x1B\[[0-?]*[ -/]*[@-~]"

# What counts as a secret in a log line, and what takes its place.
SECRET_PATTERNS = [
    (r"(?i)([?&](?:key|api_key|apikey|token|access_token|password)=)[^&\s\"'<>]+", "$1***"),
    (r"(?i)(authorization[\"']?\s*[:=]\s*[\"']?(?:(?:bearer|basic)\s+)?)[^\s\"',]+", "$1***"),
    (r"(?i)(cookie[\"']?\s*:\s*)[^\r\n]+", "$1***"),
    (r"(?i)((?:password|passwd|secret|api[_-]?key|token)[\"']?\s*[:=]\s*[\"']?)[^\s\"',&]+", "$1***"),
]
# Every pattern needs one of these words.
SECRET_WORDS = ["key", "token", "password", "passwd", "secret", "authorization", "cookie"]


def preview(message: Column, chars: int = PREVIEW_CHARS) -> Column:
    """First ``chars`` characters and an ellipsis; shorter text is unchanged."""
    return F.when(
        F.length(message) > chars, F.concat(F.substring(message, 1, chars), F.lit("..."))
    ).otherwise(message)


def strip_ansi(message: Column) -> Column:
    clean = F.regexp_replace(message, ANSI_ESCAPE, "")
    return F.when(message.contains("\x1b"), clean).otherwise(message)


def redact(message: Column) -> Column:
    """Secrets masked. The rules run only on text that holds one of their words."""
    lowered = F.lower(message)
    suspicious = reduce(lambda a, b: a | b, [lowered.contains(word) for word in SECRET_WORDS])
    masked = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), SECRET_PATTERNS, message)
    return F.when(suspicious, masked).otherwise(message)


def cut_bytes(message: Column, limit: int = MAX_RECORD_BYTES) -> Column:
    """At most ``limit`` bytes of UTF-8, ending on a character boundary."""
    raw = message.cast("binary")
    # A UTF-8 character has at most four bytes, so one of four cuts is a boundary.
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, limit - back).cast("string")) for back in range(4)
    ]
    return F.when(F.octet_length(message) > limit, F.coalesce(*cuts)).otherwise(message)
