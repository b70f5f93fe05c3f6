"""The shared Parquet tables seen as logs, and as OTLP batches made from them by Spark."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.functions.times import utc_day
from sparklog.schema import EXCEPTION_TYPE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _severity(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", 17)
        .when(event_type == "purchase", 13)
        .when(event_type == "signup", 9)
        .when(event_type == "click", 5)
        .otherwise(1)
    )


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream of log rows."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return events_as_logs(reader.parquet(sf_dir))


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_logs(table(spark, sf_dir, "events"))


def events_as_logs(events: DataFrame) -> DataFrame:
    """Events as log rows. ``ts`` stays as a column so that time bounds reach the Parquet scan."""
    time_ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("record_id"),
        time_ns.alias("time_ns"),
        (time_ns + F.col("event_id") % 1000 * 1_000_000_000).alias("ingest_ns"),
        _severity(F.col("event_type")).alias("severity"),
        F.concat(F.lit("app-"), "event_type").alias("service"),
        F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string")).alias("instance"),
        F.lit(None).cast("string").alias("version"),
        F.concat(F.lit("events."), "event_type").alias("logger"),
        F.unhex(F.md5(F.col("user_id").cast("string"))).alias("trace_id"),
        F.lit(None).cast("binary").alias("span_id"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.col("props").alias("attrs_json"),
        F.lit(None).cast(EXCEPTION_TYPE).alias("exception"),
        F.to_date("ts").alias("day"),
        "ts",
        "user_id",
    )


def logs_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log rows: the whole text is the message, a second apart from 2024-01-01."""
    time_ns = (F.lit(1_704_067_200) + F.col("doc_id")) * 1_000_000_000
    return table(spark, sf_dir, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("record_id"),
        time_ns.alias("time_ns"),
        time_ns.alias("ingest_ns"),
        F.lit(9).alias("severity"),
        F.col("source").alias("service"),
        F.col("lang").alias("instance"),
        F.lit(None).cast("string").alias("version"),
        F.lit(None).cast("string").alias("logger"),
        F.lit(None).cast("binary").alias("trace_id"),
        F.lit(None).cast("binary").alias("span_id"),
        F.col("text").alias("message"),
        F.to_json(F.struct("lang", "source")).alias("attrs_json"),
        F.lit(None).cast(EXCEPTION_TYPE).alias("exception"),
        utc_day(time_ns).alias("day"),
        "doc_id",
    )


def logs_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as log rows: one trace per conversation, one second per turn."""
    time_ns = (F.lit(1_704_067_200) + F.col("turn")) * 1_000_000_000
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("record_id"),
        time_ns.alias("time_ns"),
        time_ns.alias("ingest_ns"),
        F.when(F.col("role") == "system", 5).otherwise(9).alias("severity"),
        F.col("role").alias("service"),
        F.lit("").alias("instance"),
        F.unhex(F.md5(F.col("conv_id").cast("string"))).alias("trace_id"),
        F.col("text").alias("message"),
        utc_day(time_ns).alias("day"),
        "conv_id",
        "turn",
    )


RECORDS_PER_BATCH = 100


def _string_attr(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))


def otlp_batches_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as OTLP JSON export requests of at most 100 records, one resource per event type.

    Columns value, source, ingest_ns. Grouping is by id range, so no group grows with the data.
    """
    events = table(spark, sf_dir, "events")
    time_ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    is_error = F.col("event_type") == "error"
    attributes = F.array_compact(
        F.array(
            _any_attr("k", intValue=F.get_json_object("props", "$.k")),
            _any_attr("user.id", intValue=F.col("user_id").cast("string")),
            _any_attr("value", doubleValue=F.col("value")),
            F.when(is_error, _any_attr("exception.type", stringValue=F.lit("EventError"))),
            F.when(is_error, _any_attr("exception.message", stringValue=F.col("props"))),
            F.when(F.col("event_type") == "click", _any_attr("code.namespace", stringValue=F.lit("ui"))),
        )
    )
    record = F.struct(
        time_ns.cast("string").alias("timeUnixNano"),
        _severity(F.col("event_type")).alias("severityNumber"),
        F.struct(F.concat_ws(" ", F.lit("event"), F.col("event_id").cast("string")).alias("stringValue")).alias("body"),
        attributes.alias("attributes"),
        F.md5(F.col("user_id").cast("string")).alias("traceId"),
        # Every seventh record carries a span id of the wrong length.
        F.when(F.col("event_id") % 7 == 0, "abcd")
        .otherwise(F.lpad(F.hex("event_id"), 16, "0"))
        .alias("spanId"),
    )
    groups = events.groupBy(
        F.call_function("div", F.col("event_id"), F.lit(RECORDS_PER_BATCH)).alias("batch_no"), "event_type"
    ).agg(F.array_sort(F.collect_list(record)).alias("logRecords"))
    resource = F.struct(
        F.struct(
            F.array(
                _string_attr("service.name", F.concat(F.lit("app-"), "event_type")),
                _string_attr("service.version", F.lit("1.0")),
                _string_attr("host.name", F.concat(F.lit("h"), (F.col("batch_no") % 5).cast("string"))),
            ).alias("attributes")
        ).alias("resource"),
        F.array(
            F.struct(F.struct(F.lit("events").alias("name")).alias("scope"), F.col("logRecords"))
        ).alias("scopeLogs"),
    )
    resources = groups.select("batch_no", resource.alias("resource_logs"))
    batches = resources.groupBy("batch_no").agg(F.array_sort(F.collect_list("resource_logs")).alias("resourceLogs"))
    return batches.select(
        F.to_json(F.struct("resourceLogs")).alias("value"),
        F.concat(F.lit("events/"), F.col("batch_no").cast("string")).alias("source"),
        F.lit(INGEST_NS).cast("bigint").alias("ingest_ns"),
    )


# One second after the last event of the shared tables begins, 2024-01-31T00:00:00Z.
INGEST_NS = 1_706_659_200_000_000_000


def _any_attr(key: str, **value: Column) -> Column:
    names = {"stringValue": "string", "intValue": "string", "doubleValue": "double"}
    fields = [value.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]
    return F.struct(F.lit(key).alias("key"), F.struct(*fields).alias("value"))


def otlp_typed_batches_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as OTLP JSON with bodies and attributes of every type, enum severities, and times that are left out."""
    events = table(spark, sf_dir, "events").withColumn("e", F.col("event_id").cast("string"))
    number = F.col("event_id")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    stamp = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    observed = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 5).cast("string")
    time = F.when(number % 3 == 0, text('"timeUnixNano":"', stamp, '","observedTimeUnixNano":1,')).when(number % 3 == 1, text('"observedTimeUnixNano":"', observed, '",')).otherwise("")
    severity = F.when(number % 4 == 0, '"SEVERITY_NUMBER_TRACE"').when(number % 4 == 1, '"SEVERITY_NUMBER_INFO2"').when(number % 4 == 2, '"SEVERITY_NUMBER_FATAL4"').otherwise("13")
    array = text('{"arrayValue":{"values":[{"intValue":', F.col("e"), '},{"stringValue":"x"}]}}')
    deep = text('{"kvlistValue":{"values":[{"key":"k","value":{"arrayValue":{"values":[', array, ']}}}]}}')
    marked = text(r'{"stringValue":"\u0001otlp:{\"intValue\":', F.col("e"), '}"}')
    bodies = [marked, text('{"intValue":"', F.col("e"), '"}'), F.lit('{"boolValue":true}'), array, deep, text('{"doubleValue":', F.col("e"), ".5}"), F.lit('{"bytesValue":"AQI="}')]
    body = F.get(F.array(*bodies), (number % len(bodies)).cast("int"))
    own = F.when(number % 2 == 0, text('{"key":"host.name","value":{"stringValue":"own-', F.col("e"), '"}},')).otherwise("")
    attributes = text(
        "[", own, '{"key":"int","value":{"intValue":', F.col("e"), '}},{"key":"double","value":{"doubleValue":', F.col("e"), '.25}},',
        '{"key":"bool","value":{"boolValue":false}},{"key":"bytes","value":{"bytesValue":"AQI="}},{"key":"unset","value":{}},',
        '{"key":"list","value":', array, '},{"key":"deep","value":', deep, '},{"key":"mark","value":', marked, "}]",
    )
    record = text("{", time, '"severityNumber":', severity, ',"body":', body, ',"attributes":', attributes, "}")
    rows = events.select(F.call_function("div", number, F.lit(RECORDS_PER_BATCH)).alias("batch_no"), F.struct("event_id", record.alias("r")).alias("r"))
    joined = rows.groupBy("batch_no").agg(F.array_join(F.array_sort(F.collect_list("r"))["r"], ",").alias("records"))
    resource = '{"resourceLogs":[{"resource":{"attributes":[{"key":"host.name","value":{"stringValue":"outer"}}]},"scopeLogs":[{"logRecords":['
    return joined.select(
        text(resource, F.col("records"), "]}]}]}").alias("value"),
        F.concat(F.lit("typed/"), F.col("batch_no").cast("string")).alias("source"),
        F.lit(INGEST_NS).cast("bigint").alias("ingest_ns"),
    )


def land_bodies(bodies: DataFrame, folder: str) -> None:
    """Land (name, value) as one file each, as senders of binary batches would; Spark itself writes no such files."""
    uri = folder if "://" in folder else folder.replace("file:", "", 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(uri)
        store.create_dir(root)
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}") as file:
                    file.write(value)
            yield batch.select(["name"])

    bodies.select("name", "value").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
