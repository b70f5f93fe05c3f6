from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE_BYTES = 16
SPAN_BYTES = 8


def hex_id(value: Column) -> Column:
    """Binary id as lower-case hex."""
    return F.lower(F.hex(value))


def parse_hex_id(text: Column, size: int) -> Column:
    """Hex text of exactly ``size`` bytes, else NULL."""
    return F.when(F.length(text) == 2 * size, F.try_to_binary(text, F.lit("hex")))


def decode_id(text: Column, size: int, encoding: str = "hex") -> Column:
    """An id as it stands in OTLP JSON; NULL unless it decodes to exactly ``size`` bytes."""
    if encoding == "hex":
        return parse_hex_id(text, size)
    if encoding != "base64":
        raise ValueError(f"id encoding {encoding!r}: use 'hex' or 'base64'")
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.when(F.octet_length(raw) == size, raw)
