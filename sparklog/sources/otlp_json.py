"""OTLP JSON batches: one export request per line (or per file) to one row per log record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.functions.anyvalue import ANY_VALUE, is_deep, is_finite, to_text, to_variant, to_wire
from sparklog.sources.otlp_format import breaks_format, canonical
from sparklog.schema import MAX_BATCH_BYTES, SERVICE_INSTANCE, SERVICE_NAME, SERVICE_VERSION

_KEY_VALUES = f"ARRAY<STRUCT<key: STRING, value: {ANY_VALUE}>>"
_RECORD = (
    "STRUCT<timeUnixNano: STRING, observedTimeUnixNano: STRING, severityNumber: STRING, "
    f"body: {ANY_VALUE}, attributes: {_KEY_VALUES}, traceId: STRING, spanId: STRING>"
)
_SCOPE_LOGS = f"STRUCT<scope: STRUCT<name: STRING>, logRecords: ARRAY<{_RECORD}>>"
_RESOURCE_LOGS = f"STRUCT<resource: STRUCT<attributes: {_KEY_VALUES}>, scopeLogs: ARRAY<{_SCOPE_LOGS}>>"
BATCH_SCHEMA = f"resourceLogs ARRAY<{_RESOURCE_LOGS}>, malformed STRING"


def _with_source(lines: DataFrame) -> DataFrame:
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("source"),
        # The file's own time, so a replayed micro-batch judges record age the same way.
        (F.unix_micros("_metadata.file_modification_time") * 1000).alias("ingest_ns"),
    )


def read_batches(spark: SparkSession, path: str | list[str], whole_files: bool = False) -> DataFrame:
    """Batches landed as text files: columns value, source, ingest_ns."""
    return _with_source(spark.read.text(path, wholetext=whole_files))


def read_batches_stream(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """The same as a stream. The trigger limits are the back-pressure: nothing is dropped."""
    reader = spark.readStream.option("wholetext", str(whole_files).lower())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return _with_source(reader.format("text").load(path))


def parse_batches(batches: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``batch`` (parsed, NULL if rejected), ``batch_key`` and ``batch_reject``.

    ``strict`` also refuses batches with a field name that the format does not define at its place, and values
    that are not of their field's type. Names may be spelled ``resourceLogs`` or ``resource_logs``.
    """
    # A converted batch brings the size of the body it was made from.
    size = F.col("body_bytes") if "body_bytes" in batches.columns else F.octet_length("value")
    oversize = size > MAX_BATCH_BYTES
    parsed = (
        batches.where(F.trim("value") != "")
        .withColumn("batch_key", F.md5(F.concat_ws("|", "source", "value")))
        .withColumn("named", F.when(~oversize, canonical(F.col("value"))))
        .withColumn(
            "parsed",
            F.from_json(
                "named",
                BATCH_SCHEMA,
                {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"},
            ),
        )
    )
    bad = F.col("parsed").isNull() | F.col("parsed.malformed").isNotNull()
    if strict:
        bad = bad | F.coalesce(breaks_format(F.col("named")), F.lit(True))
    reason = F.when(oversize, "oversize").when(bad, "bad_format")
    return (
        parsed.withColumn("batch_reject", reason)
        .withColumn("batch", F.when(F.col("batch_reject").isNull(), F.col("parsed.resourceLogs")))
        .drop("parsed", "named")
    )


def rejected_batches(parsed: DataFrame) -> DataFrame:
    """Whole batches that were refused, with the reason: ``oversize`` or ``bad_format``."""
    return parsed.where(F.col("batch_reject").isNotNull()).select(
        "batch_key", "source", "ingest_ns", F.col("batch_reject").alias("reject_reason"), "value"
    )


def _listed(keys: list[str]) -> str:
    return ", ".join(f"'{key}'" for key in keys)


def entries(pairs: str) -> Column:
    """Attribute list as a map, the last of equal keys winning."""
    named = f"transform({pairs}, kv -> named_struct('key', coalesce(kv.key, ''), 'value', kv.value))"
    return F.expr(f"coalesce(map_from_entries({named}), CAST(map() AS MAP<STRING, {ANY_VALUE}>))")


def plain_attributes(attributes: str, promoted: list[str]) -> Column:
    """Map of VARIANT without the promoted keys, without values JSON cannot hold and without deep ones."""
    kept = f"map_filter({attributes}, (k, v) -> k NOT IN ({_listed(promoted)}) AND {is_finite('v')} AND NOT {is_deep('v')})"
    return F.expr(f"transform_values({kept}, (k, v) -> {to_variant('v')})")


def deep_attributes(attributes: str, promoted: list[str]) -> Column:
    """Map of the deep values in wire form, without the promoted keys."""
    kept = f"map_filter({attributes}, (k, v) -> k NOT IN ({_listed(promoted)}) AND {is_deep('v')})"
    return F.expr(f"transform_values({kept}, (k, v) -> {to_wire('v')})")


def text_attributes(attributes: str, keys: list[str]) -> Column:
    """Map of text for the given keys only."""
    kept = f"map_filter({attributes}, (k, v) -> k IN ({_listed(keys)}))"
    return F.expr(f"transform_values({kept}, (k, v) -> {to_text('v')})")


def dropped_values(attributes: str) -> Column:
    return F.expr(f"size(map_filter({attributes}, (k, v) -> NOT ({is_finite('v')})))")


def flatten(parsed: DataFrame) -> DataFrame:
    """Resource -> scope -> record, one row per log record.

    What belongs to the resource is worked out once per resource, before its records fan out.
    The outer explodes keep Catalyst from repeating the JSON parse inside a derived filter.
    """
    promoted = [SERVICE_NAME, SERVICE_VERSION, SERVICE_INSTANCE]

    resources = parsed.select(
        "batch_key", "ingest_ns", F.posexplode_outer("batch").alias("resource_pos", "resource_logs")
    ).where(F.col("resource_logs").isNotNull())
    resources = resources.withColumn("resource_map", entries("resource_logs.resource.attributes"))
    scopes = resources.select(
        "batch_key",
        "ingest_ns",
        "resource_pos",
        text_attributes("resource_map", promoted).alias("promoted"),
        plain_attributes("resource_map", promoted).alias("resource_attrs"),
        deep_attributes("resource_map", promoted).alias("resource_deep"),
        dropped_values("resource_map").alias("resource_dropped"),
        F.posexplode_outer("resource_logs.scopeLogs").alias("scope_pos", "scope_logs"),
    ).where(F.col("scope_logs").isNotNull())
    carried = [c for c in scopes.columns if c != "scope_logs"]
    return scopes.select(
        *carried,
        F.coalesce("scope_logs.scope.name", F.lit("")).alias("scope_name"),
        F.posexplode_outer("scope_logs.logRecords").alias("record_pos", "record"),
    ).where(F.col("record").isNotNull())
