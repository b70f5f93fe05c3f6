"""Registered queries: counts, introspection, rollups, alerts, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.operators import safety, summary
from sparklog.operators.alerts import error_rate_alert as alert
from sparklog.operators.ingest import age_reason
from sparklog.operators.rollup import hourly_rollup as rollup
from sparklog.operators.rollup import write_rollup
from sparklog.operators.throttle import throttle
from sparklog.plans.reads import DAY_NS, SINCE, SINCE_NS, UNTIL, UNTIL_NS
from sparklog.plans.registry import SQL_LABEL, SQL_LOGS, from_logs, registered, sql_rfc3339
from sparklog.plans.rollup_routing import summary_from_rollup
from sparklog.schema import NS_PER_HOUR
from sparklog.session import scratch_path
from sparklog.sources.driver_tables import INGEST_NS, logs_from_documents, logs_from_events

RANGE = f"time_ns >= {SINCE_NS} AND time_ns < {UNTIL_NS}"


@registered(from_logs("SELECT DISTINCT service FROM logs"))
def distinct_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.distinct_services(logs_from_events(spark, sf_dir))


@registered(
    from_logs("""SELECT CAST(day AS VARCHAR) AS day, count(*) AS row_count, min(ingest_ns) AS first_ingest_ns,
    max(ingest_ns) AS last_ingest_ns FROM logs GROUP BY day""")
)
def partition_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = summary.partition_info(logs_from_events(spark, sf_dir))
    return info.withColumn("day", F.col("day").cast("string"))


@registered(from_logs("SELECT count(DISTINCT day) AS partitions FROM logs"))
def partition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.partition_count(logs_from_events(spark, sf_dir))


@registered(from_logs(f"SELECT service, {SQL_LABEL} AS severity, count(*) AS count FROM logs GROUP BY ALL"))
def summary_service_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary(logs_from_events(spark, sf_dir))


@registered(
    from_logs(f"""SELECT service, {SQL_LABEL} AS severity, count(*) AS count FROM logs
    WHERE time_ns >= {INGEST_NS - DAY_NS} GROUP BY ALL""")
)
def summary_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary(logs_from_events(spark, sf_dir), since="24h", now_ns=INGEST_NS)


@registered(
    from_logs(f"""SELECT json_extract_string(attrs_json, '$.k') AS "attr.k", logger, {SQL_LABEL} AS severity,
    count(*) AS count FROM logs WHERE {RANGE} GROUP BY ALL""")
)
def summary_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("attr.k", "logger", "severity")
    return summary.summary(logs_from_events(spark, sf_dir), by, since=SINCE, until=UNTIL)


@registered(
    from_logs(f"""SELECT service, count(*) AS records, count(*) FILTER (severity >= 17
    AND time_ns >= {INGEST_NS - NS_PER_HOUR} AND time_ns < {INGEST_NS}) AS last_hour_errors,
    max(time_ns) AS newest_ns FROM logs GROUP BY service""")
)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.overview(logs_from_events(spark, sf_dir), INGEST_NS)


@registered(
    from_logs(f"""SELECT DISTINCT 'service' AS field, service AS value FROM logs
    UNION SELECT 'logger', logger FROM logs UNION SELECT 'severity', {SQL_LABEL} FROM logs
    UNION SELECT 'attribute_key', unnest(json_keys(attrs_json)) FROM logs""")
)
def introspect_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.introspect(logs_from_events(spark, sf_dir))


@registered(from_logs("SELECT DISTINCT unnest(json_keys(attrs_json)) AS attribute_key FROM logs"))
def introspect_attr_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.attribute_keys(logs_from_events(spark, sf_dir))


@registered(
    from_logs(f"""SELECT {sql_rfc3339('min(time_ns)')} AS oldest_record_ts, {sql_rfc3339('max(time_ns)')}
    AS newest_record_ts, CAST(7 AS INTEGER) AS retention_days FROM logs""")
)
def introspect_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.bounds(logs_from_events(spark, sf_dir))


@registered(
    from_logs("""SELECT time_ns // 3600000000000 * 3600000000000 AS bucket_ns, count(*) AS rows,
    round(count(*) / 3600.0, 6) AS rows_per_second FROM logs GROUP BY 1""")
)
def ingest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.ingest_rate(logs_from_events(spark, sf_dir))


@registered(
    from_logs("""SELECT time_ns // 3600000000000 * 3600000000000 AS hour_ns, service, severity, count(*) AS count
    FROM logs GROUP BY ALL""")
)
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(logs_from_events(spark, sf_dir))


@registered(
    from_logs(f"SELECT service, {SQL_LABEL} AS severity, count(*) AS count FROM logs WHERE {RANGE} GROUP BY ALL")
)
def summary_by_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_from_events(spark, sf_dir)
    path = scratch_path(spark, "rollup")
    write_rollup(logs, path)
    return summary_from_rollup(spark.read.parquet(path), logs, SINCE, UNTIL)


@registered(
    from_logs("""SELECT time_ns // 3600000000000 * 3600000000000 AS window_ns, service,
    count(*) FILTER (severity >= 17) AS errors, count(*) AS records FROM logs GROUP BY ALL
    HAVING errors > 0 AND records >= 2 AND errors * 2 >= records""")
)
def error_rate_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert(logs_from_events(spark, sf_dir), window_seconds=3600, threshold=0.5, min_records=2)


@registered(
    from_logs("""SELECT service, count(*) AS records, count(*) FILTER (ingest_ns - time_ns > 300000000000) AS behind,
    count(*) FILTER (time_ns - ingest_ns > 300000000000) AS ahead FROM logs GROUP BY service
    HAVING behind > 0 OR ahead > 0""")
)
def clock_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.clock_skew(logs_from_events(spark, sf_dir))


@registered(
    from_logs(f"""SELECT coalesce(CASE WHEN {INGEST_NS} - time_ns > {15 * DAY_NS} THEN 'too_old' END, 'accepted')
    AS outcome, service, count(*) AS records FROM logs GROUP BY ALL""")
)
def age_reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = age_reason(F.col("time_ns"), F.lit(INGEST_NS), 15 * DAY_NS)
    logs = logs_from_events(spark, sf_dir).withColumn("outcome", F.coalesce(reason, F.lit("accepted")))
    return logs.groupBy("outcome", "service").agg(F.count("*").alias("records"))


def _throttle_sql(key: str, gap: int) -> str:
    name, on = (f"{key}, ", f"o.{key} = k.{key} AND ") if key else ("", "")
    qualified = f"k.{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""WITH RECURSIVE {SQL_LOGS}, slim AS (SELECT {name}time_ns, min(record_id) AS record_id FROM logs
      GROUP BY ALL), kept AS (
      SELECT {name}min(time_ns) AS time_ns FROM slim {group}
      UNION ALL
      SELECT {qualified}min(o.time_ns) AS time_ns FROM kept k JOIN slim o ON {on}o.time_ns >= k.time_ns + {gap}
      {"GROUP BY k." + key if key else "HAVING min(o.time_ns) IS NOT NULL"})
    SELECT {name}time_ns, record_id FROM slim JOIN kept USING ({name}time_ns)"""


@registered(_throttle_sql("user_id", DAY_NS))
def throttle_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = throttle(logs_from_events(spark, sf_dir), ["user_id"], DAY_NS)
    return kept.select("user_id", "time_ns", "record_id")


@registered(_throttle_sql("", NS_PER_HOUR))
def throttle_one_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    # fold_rows is set low so that the single slot takes the distributed way.
    kept = throttle(logs_from_events(spark, sf_dir), None, NS_PER_HOUR, fold_rows=2_000)
    return kept.select("time_ns", "record_id")


@registered(
    from_logs(f"""SELECT user_id, time_ns, record_id FROM logs QUALIFY row_number() OVER
    (PARTITION BY user_id, time_ns // {DAY_NS} ORDER BY time_ns, record_id) <= 2""")
)
def rate_limit_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_from_events(spark, sf_dir)
    kept = safety.rate_limit(logs, "user_id", per_minute=2, minute_ns=DAY_NS)
    return kept.select("user_id", "time_ns", "record_id")


@registered(
    from_logs("""SELECT service, severity, count(*) AS records FROM logs WHERE severity >= 9 OR day NOT IN (
      SELECT day FROM logs GROUP BY day HAVING sum(strlen(message)) * 100 > count(*) * 1660) GROUP BY ALL""")
)
def disk_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Text bytes beyond 16.6 a row stand in for the stored bytes of a day.
    logs = logs_from_events(spark, sf_dir)
    sizes = logs.groupBy("day").agg(
        (F.sum(F.octet_length("message")) * 100 - F.count("*") * 1660).alias("byte_size")
    )
    kept = safety.disk_guard(logs, sizes, limit=0)
    return kept.groupBy("service", "severity").agg(F.count("*").alias("records"))


@registered("SELECT count(*) FILTER (strlen(text) > 2048) AS truncated_records FROM documents")
def truncated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.truncated_count(logs_from_documents(spark, sf_dir), 2048)


@registered(
    """SELECT doc_id,
      CASE WHEN strlen(text) > 2048 THEN left(text, CAST(list_max(list_filter(range(512, 2049),
        lambda n: strlen(left(text, CAST(n AS INTEGER))) <= 2048)) AS INTEGER)) ELSE text END AS message,
      '{"lang":"' || lang || '","source":"' || source || '"' ||
      CASE WHEN strlen(text) > 2048 THEN ',"truncated":true}' ELSE '}' END AS attrs_json
    FROM documents"""
)
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = safety.cap_record_size(logs_from_documents(spark, sf_dir), 2048)
    return capped.select("doc_id", "message", "attrs_json")


@registered(
    """SELECT doc_id, strlen(text) * 3 + strlen(CAST(to_json(text) AS VARCHAR)) + 18 > 4096 AS truncated,
    true AS fits, true AS whole_start, true AS valid FROM documents"""
)
def size_cap_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text as message, twice as stack trace and once as attribute: all together at most 4 KB."""
    logs = logs_from_documents(spark, sf_dir)
    text = F.col("message")
    attrs = F.to_json(F.struct(F.lit("x").alias("a"), text.alias("text")))
    exception = F.struct(F.lit("E").alias("type"), F.lit("").alias("message"), F.concat(text, text).alias("stacktrace"))
    whole = logs.withColumn("attrs_json", attrs).withColumn("exception", exception).withColumn("original", text)
    capped = safety.cap_whole_record(whole, 4096)
    mark = F.get_json_object("attrs_json", "$.truncated")
    return capped.select(
        "doc_id",
        (F.coalesce(mark, F.lit("")) == "true").alias("truncated"),
        (safety.record_bytes(capped) <= 4096).alias("fits"),
        (F.startswith("original", "message") & F.startswith(F.concat("original", "original"), "exception.stacktrace")).alias("whole_start"),
        F.try_parse_json("attrs_json").isNotNull().alias("valid"),
    )
