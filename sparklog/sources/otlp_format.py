"""Is a JSON text an OTLP logs export request: names and types by level.

The check reads the schema of the parsed batch, ``OBJECT<resourceLogs: ARRAY<...>>``, in which Spark
has joined the elements of arrays. Values nest in each other without bound, so their part of the schema is
reduced from the inside: every well-formed value becomes ``#V``, every key-value pair ``#K``, until nothing changes.
What is left has four fixed levels and must match one pattern. Texts that must hold numbers are
then cast. A quoted name followed by a colon is a field wherever it stands, because quotes
within texts are escaped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of the OTLP logs messages and the types their JSON forms may have.
_TEXT = "STRING|VOID"
_NUMBER = r"BIGINT|DOUBLE|DECIMAL\(\d+,\s?\d+\)|STRING|VARIANT|VOID"
_VALUE, _PAIR, _EMPTY = "#V", "#K", "OBJECT<>"


def _object(fields: dict[str, str], least: int = 0) -> str:
    """An object with any of the fields, in any order."""
    field = "(?:" + "|".join(f"{name}: (?:{kind})" for name, kind in fields.items()) + ")"
    more = f"(?:{field}(?:, {field})*)"
    return f"OBJECT<{more}>" if least else f"OBJECT<{more}?>"


def _list(kind: str) -> str:
    return f"VOID|ARRAY<(?:{kind}|VOID|{_EMPTY})>"


_VALUE_FIELDS = {
    "stringValue": _TEXT,
    "boolValue": "BOOLEAN|VOID",
    "intValue": _NUMBER,
    "doubleValue": _NUMBER,
    "bytesValue": _TEXT,
    "arrayValue": f"#L|VOID|{_EMPTY}",
    "kvlistValue": f"#M|VOID|{_EMPTY}",
}
#: From the innermost value outwards, as often as values nest.
_REDUCTIONS = [
    (_object(_VALUE_FIELDS, 1), _VALUE),
    (_object({"key": _TEXT, "value": f"{_VALUE}|VOID|{_EMPTY}"}, 1), _PAIR),
    (f"arrayValue: {_object({'values': _list(_VALUE)}, 1)}", "arrayValue: #L"),
    (f"kvlistValue: {_object({'values': _list(_PAIR)}, 1)}", "kvlistValue: #M"),
]
_ATTRIBUTES = {"attributes": _list(_PAIR), "droppedAttributesCount": _NUMBER}
_RECORD = _object(
    {
        "timeUnixNano": _NUMBER,
        "observedTimeUnixNano": _NUMBER,
        "severityNumber": _NUMBER,
        "severityText": _TEXT,
        "body": f"{_VALUE}|VOID|{_EMPTY}",
        **_ATTRIBUTES,
        "flags": _NUMBER,
        "traceId": _TEXT,
        "spanId": _TEXT,
        "eventName": _TEXT,
    }
)
_SCOPE = _object({"name": _TEXT, "version": _TEXT, **_ATTRIBUTES})
_SCOPE_LOGS = _object({"scope": f"{_SCOPE}|VOID", "logRecords": _list(_RECORD), "schemaUrl": _TEXT})
_ENTITY = _object({"type": _TEXT, "schemaUrl": _TEXT, "idKeys": "VOID|ARRAY<(?:STRING|VOID)>", "descriptionKeys": "VOID|ARRAY<(?:STRING|VOID)>"})
_RESOURCE = _object({**_ATTRIBUTES, "entityRefs": _list(_ENTITY)})
_RESOURCE_LOGS = _object({"resource": f"{_RESOURCE}|VOID", "scopeLogs": _list(_SCOPE_LOGS), "schemaUrl": _TEXT})
_REQUEST = _object({"resourceLogs": _list(_RESOURCE_LOGS)})

# The field names that have two words or more, as JSON spells them.
_LONG_NAMES = [
    "resourceLogs", "scopeLogs", "schemaUrl", "logRecords", "droppedAttributesCount", "entityRefs",
    "timeUnixNano", "observedTimeUnixNano", "severityNumber", "severityText", "traceId", "spanId", "eventName",
    "stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue",
    "idKeys", "descriptionKeys",
]


def _original(name: str) -> str:
    return re.sub("[A-Z]", lambda letter: f"_{letter[0].lower()}", name)


def canonical(json_text: Column) -> Column:
    """The text with original field names (``resource_logs``) as JSON spells them (``resourceLogs``)."""
    originals = {_original(name): name for name in _LONG_NAMES}
    renamed = json_text
    for original, name in originals.items():
        renamed = F.regexp_replace(renamed, rf'"{original}"(\s*):', rf'"{name}"$1:')
    # The look ahead turns away most quotes at once: all original names have an underscore after small letters.
    return F.when(json_text.rlike(rf'"(?=[a-z]++_)(?:{"|".join(originals)})"\s*:'), renamed).otherwise(json_text)


def _reduced(schema: Column) -> Column:
    def once(text: Column, _: Column) -> Column:
        for pattern, mark in _REDUCTIONS:
            text = F.regexp_replace(text, pattern, mark)
        return text

    levels = F.regexp_count(schema, F.lit("arrayValue: OBJECT|kvlistValue: OBJECT")) + 1
    return F.aggregate(F.sequence(F.lit(1), levels), schema, once)


def _some_field(json_text: Column, name: str, bad) -> Column:
    """Whether some field of that name, at any level, has a bad value; ``bad`` gets the text between quotes or commas."""
    found = F.regexp_extract_all(json_text, F.lit(rf'"{name}"\s*:\s*"?([^",\s\]}}]*)'), F.lit(1))
    return json_text.contains(f'"{name}"') & F.exists(found, lambda text: (text != "null") & bad(text))


def breaks_format(json_text: Column) -> Column:
    """True if the text is not exactly one JSON object of the form of a logs export request."""
    # In brackets, text after the object turns into a syntax error or a second element.
    wrapped = F.try_parse_json(F.concat(F.lit("["), json_text, F.lit("]")))

    def broken(batch: Column) -> Column:
        second = F.try_variant_get(batch, "$[1]", "variant").isNotNull()
        schema = F.schema_of_variant(F.try_variant_get(batch, "$[0]", "variant"))
        return batch.isNull() | second | ~_reduced(schema).rlike(f"^(?:{_REQUEST})$")

    numbers = _some_field(json_text, "intValue", lambda text: text.try_cast("bigint").isNull())
    doubles = _some_field(json_text, "doubleValue", lambda text: text.try_cast("double").isNull())
    as_base64 = F.translate  # senders may write the letters that are safe in addresses
    binary = _some_field(json_text, "bytesValue", lambda text: F.try_to_binary(as_base64(text, "-_", "+/"), F.lit("base64")).isNull())
    return F.exists(F.array(wrapped), broken) | numbers | doubles | binary
