"""OTLP AnyValue: the wire form (a one-of wrapper) to VARIANT and to text.

The expressions are SQL text for ``F.expr``: as Column calls they would cost several seconds
of driver time in every micro-batch, nearly all of it Python-to-JVM round trips.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scalars are read as raw text, because OTLP JSON writes 64-bit numbers as strings and
# senders also use bare numbers. Nested values stay raw JSON until they are needed.
ANY_VALUE = (
    "STRUCT<stringValue: STRING, boolValue: STRING, intValue: STRING, doubleValue: STRING, "
    "bytesValue: STRING, arrayValue: STRUCT<values: ARRAY<STRING>>, "
    "kvlistValue: STRUCT<values: ARRAY<STRUCT<key: STRING, value: STRING>>>>"
)

# Levels of nesting the generated expression unwraps. Deeper values are told apart by ``is_deep``, kept
# in wire form in a column of their own, and unwrapped by ``unwrap_deep``.
NESTING = 1


def _let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _double(value: str) -> str:
    return f"try_cast({value}.doubleValue AS DOUBLE)"


def is_finite(value: str) -> str:
    """False for a NaN or infinite double; JSON has no form for those."""
    number = _double(value)
    return f"NOT coalesce(isnan({number}) OR abs({number}) = double('Infinity'), false)"


def _children(value: str) -> str:
    """The values of a list or of key-value pairs, as raw JSON under their keys."""
    return (
        f"coalesce({value}.kvlistValue.values, transform({value}.arrayValue.values, "
        "raw -> named_struct('key', CAST(NULL AS STRING), 'value', raw)), "
        "CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>))"
    )


def is_deep(value: str) -> str:
    """Whether a value nests deeper than ``to_variant`` unwraps: a child is a list or key-value pairs itself.

    A name in quotes followed by a colon is a field of the child: quotes within its texts are escaped.
    """
    return rf"""exists({_children(value)}, child -> coalesce(child.value RLIKE r'"(arrayValue|kvlistValue)"\s*:', false))"""


def to_wire(value: str) -> str:
    return f"to_json({value})"


def _nested_variant(value: str, depth: int) -> str:
    if depth == 0:
        return "CAST(NULL AS VARIANT)"
    plain = _let(f"from_json(e.value, '{ANY_VALUE}')", "inner", to_variant("inner", depth - 1))
    entries = f"transform({_children(value)}, e -> named_struct('key', coalesce(e.key, ''), 'value', {plain}))"
    return _let(
        entries,
        "items",
        f"CASE WHEN {value}.kvlistValue IS NOT NULL THEN to_variant_object(map_from_entries(items)) "
        f"WHEN {value}.arrayValue IS NOT NULL THEN to_variant_object(transform(items, e -> e.value)) END",
    )


def to_variant(value: str, depth: int = NESTING) -> str:
    """Native VARIANT of an ANY_VALUE struct; an unset value is NULL."""
    return (
        f"coalesce(CAST({value}.stringValue AS VARIANT), "
        f"CAST(try_cast({value}.boolValue AS BOOLEAN) AS VARIANT), "
        f"CAST(try_cast({value}.intValue AS BIGINT) AS VARIANT), "
        f"CAST(CASE WHEN {is_finite(value)} THEN {_double(value)} END AS VARIANT), "
        f"CAST({value}.bytesValue AS VARIANT), {_nested_variant(value, depth)})"
    )


def format_double(number: str) -> str:
    """Shortest general form: 1e+06 from a million up, 1e-05 below 0.0001, no trailing ``.0``."""
    text = "CAST(n AS STRING)"
    # Spark writes 1.5E7 and 2.0E-4: split off mantissa and exponent.
    mantissa = rf"regexp_replace(split_part({text}, 'E', 1), r'\.0$', '')"
    exponent = f"try_cast(split_part({text}, 'E', 2) AS INT)"
    # 1000000.0 up to 9999999.9 come without exponent: move the point six places.
    moved = rf"regexp_replace({text}, r'^(-?\d)(\d{{6}})\.(\d+)$', '$1.$2$3')"
    moved = rf"regexp_replace({moved}, r'\.?0+$', '')"
    # 0.0001 up to 0.000999 come as x.yE-4: write them out.
    small = f"concat(CASE WHEN n < 0 THEN '-0.000' ELSE '0.000' END, regexp_replace({mantissa}, r'[-.]', ''))"
    scientific = (
        f"concat({mantissa}, CASE WHEN {exponent} < 0 THEN 'e-' ELSE 'e+' END, "
        f"CASE WHEN abs({exponent}) < 10 THEN '0' ELSE '' END, CAST(abs({exponent}) AS STRING))"
    )
    return _let(
        number,
        "n",
        f"CASE WHEN isnan(n) THEN 'NaN' WHEN n = double('Infinity') THEN '+Inf' "
        f"WHEN n = double('-Infinity') THEN '-Inf' "
        f"WHEN abs(n) >= 1e-4 AND abs(n) < 1e-3 THEN {small} "
        f"WHEN abs(n) >= 1e6 AND abs(n) < 1e7 THEN concat({moved}, 'e+06') "
        f"WHEN {exponent} IS NOT NULL THEN {scientific} "
        rf"ELSE regexp_replace({text}, r'\.0$', '') END",
    )


def to_text(value: str) -> str:
    """Best-effort text: bytes as hex, nested values as JSON, unset as the empty string.

    A value that is deep comes out in wire form.
    """
    nested = (
        "CASE WHEN av.arrayValue IS NULL AND av.kvlistValue IS NULL THEN NULL "
        f"WHEN {is_deep('av')} THEN {to_wire('av')} ELSE to_json({to_variant('av')}) END"
    )
    return _let(
        value,
        "av",
        "coalesce(av.stringValue, CAST(try_cast(av.boolValue AS BOOLEAN) AS STRING), "
        "CAST(try_cast(av.intValue AS BIGINT) AS STRING), "
        f"CASE WHEN av.doubleValue IS NOT NULL THEN {format_double(_double('av'))} END, "
        f"lower(hex(try_to_binary(av.bytesValue, 'base64'))), {nested}, '')",
    )


def _unwrapper():
    """The Arrow UDF behind ``unwrap_deep``; self-contained, so executors need no package."""

    def number(value):
        if value - value != 0:
            return "null"  # NaN and infinities have no JSON form
        return repr(value) if "e" in repr(value) else f"{value!r}e0"  # with an exponent it is read as a double

    def plain(value):
        # One wire AnyValue as JSON text; nested ones may still be JSON text in wire form.
        value = json.loads(value) if isinstance(value, str) else value or {}
        if value.get("stringValue") is not None:
            return json.dumps(value["stringValue"], ensure_ascii=False)
        if value.get("boolValue") is not None:
            return "true" if value["boolValue"] in (True, "true") else "false"
        if value.get("intValue") is not None:
            return str(int(value["intValue"]))
        if value.get("doubleValue") is not None:
            return number(float(value["doubleValue"]))
        if value.get("bytesValue") is not None:
            return json.dumps(value["bytesValue"])
        if value.get("arrayValue") is not None:
            return "[" + ",".join([plain(v) for v in value["arrayValue"].get("values") or []]) + "]"
        if value.get("kvlistValue") is not None:
            pairs = {kv.get("key") or "": plain(kv.get("value")) for kv in value["kvlistValue"].get("values") or []}
            return "{" + ",".join([f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in pairs.items()]) + "}"
        return "null"

    def whole(wires):
        found = []
        for wire in wires:
            try:
                found.append(plain(wire))
            except (ValueError, TypeError, AttributeError, RecursionError):
                found.append("null")  # only a decoder that is not strict lets such a value through
        return found

    def unwrap(wires: pd.Series) -> pd.Series:
        return wires.map(whole, na_action="ignore")

    return F.pandas_udf(unwrap, T.ArrayType(T.StringType()))


def unwrap_deep(wires: Column) -> Column:
    """Plain JSON texts of values in wire form. Rows without any send only a NULL to Python."""
    return _unwrapper()(F.when(F.size(wires) > 0, wires))
