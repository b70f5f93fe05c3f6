"""Steps of the batch ingest whose cost must stay in proportion to the batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.plans.ingests import _spoiled
from sparklog.sources.otlp_format import canonical


def events(spark, tmp_path, n=500):
    rows = spark.range(n).selectExpr(
        "id AS event_id", "timestamp_seconds(1705000000 + id) AS ts", "id % 7 AS user_id",
        "'error' AS event_type", "CAST(id AS DOUBLE) AS value", "'{\"k\": 1}' AS props",
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_padding_is_not_copied_byte_by_byte(spark, tmp_path):
    """Exactly one byte over the limit, the batch first and blanks after it; rpad took most of the query's time."""
    spoiled = _spoiled(spark, events(spark, tmp_path))
    padded = spoiled.where(F.col("source") == "events/3")
    limit = 4 * 1024 * 1024
    row = padded.select(F.octet_length("value"), F.length(F.rtrim("value")), F.left("value", F.lit(15))).first()
    assert row[0] == limit + 1 and 0 < row[1] < limit and row[2] == '{"resourceLogs"'
    assert "rpad" not in spoiled._jdf.queryExecution().optimizedPlan().toString()


def test_look_for_original_names_turns_most_quotes_away(spark):
    """Original names are still found wherever they stand; texts and other names with an underscore are left alone."""
    texts = [
        ('{"resource_logs" : [{"scope_logs":[]}]}', '{"resourceLogs" : [{"scopeLogs":[]}]}'),
        ('{"dropped_attributes_count":1}', '{"droppedAttributesCount":1}'),
        ('{"body":{"string_value":"time_unix_nano"}}', '{"body":{"stringValue":"time_unix_nano"}}'),
        ('{"body":{"stringValue":"a_b"},"my_name":1}', '{"body":{"stringValue":"a_b"},"my_name":1}'),
    ]
    found = spark.createDataFrame(texts, "text string, wanted string").select(canonical(F.col("text")).alias("named"), "wanted")
    assert all(row.named == row.wanted for row in found.collect())
    assert "(?=[a-z]++_)" in found._jdf.queryExecution().analyzed().toString()


def test_codec_agrees_with_the_library_without_its_writer(monkeypatch):
    """Plain batches go past json_format both ways, with the same bytes and texts; others are judged by it."""
    import json

    import pyarrow as pa
    import pytest
    from google.protobuf import json_format

    from sparklog.sources.otlp_protobuf import _codec

    values = [
        {"stringValue": ""}, {"stringValue": "é\u0001"}, {"boolValue": False}, {"intValue": "-9223372036854775808"}, {"int_value": 0},
        {"doubleValue": 1}, {"doubleValue": 1e300}, {"bytesValue": "_-8"}, {}, {"arrayValue": {"values": [{"intValue": 5}, {}]}},
        {"kvlistValue": {"values": [{"key": "k", "value": {"arrayValue": {}}}, {}]}},
    ]
    attributes = [{"key": str(n), "value": value} for n, value in enumerate(values)]
    record = {"timeUnixNano": str(2**64 - 1), "severity_number": 9, "body": {"stringValue": "x"}, "attributes": attributes, "traceId": "q83v"}
    plain = {"resourceLogs": [{"resource": {}, "scope_logs": [{"scope": {"name": "s"}, "logRecords": [record, {}]}]}]}
    odd = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":null,"body":{"doubleValue":"NaN"}}]}]}]}'

    def both(texts):
        bodies = next(_codec("encode")(iter([pa.record_batch({"value": texts})]))).column("value")
        return bodies.to_pylist(), next(_codec("decode")(iter([pa.record_batch({"value": bodies})]))).column("value").to_pylist()

    request = _request_class()
    bodies, texts = both([json.dumps(plain), "{}", odd])
    for text, body, back in zip([json.dumps(plain), "{}", odd], bodies, texts, strict=True):
        message = json_format.Parse(text, request())
        assert message.SerializeToString() == body
        assert back == json_format.MessageToJson(message, indent=None)
    for bad in ('{"surprise":1}', '{"resourceLogs":[],"resourceLogs":[]}', '{"resourceLogs":[{"scopeLogs":5}]}'):
        with pytest.raises(json_format.ParseError):
            both([bad])
    calls = []
    monkeypatch.setattr(json_format, "Parse", lambda *a: calls.append(a))
    monkeypatch.setattr(json_format, "MessageToJson", lambda *a, **k: calls.append(a))
    assert both([json.dumps(plain)])[0] == bodies[:1] and not calls


def _request_class():
    """The codec's own message class."""
    from sparklog.sources.otlp_protobuf import _codec

    encode = _codec("encode")
    cells = dict(zip(encode.__code__.co_freevars, (cell.cell_contents for cell in encode.__closure__), strict=True))
    return cells["request_class"]()
