"""Registered queries: filtered reads, paging, correlation, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.functions.times import to_ns
from sparklog.functions.tokens import near, phrase, prefix, term, tokens
from sparklog.operators import correlate as correlation
from sparklog.operators import query as q
from sparklog.operators import paging, position_index, search
from sparklog.operators.safety import pin_service
from sparklog.operators.summary import distinct_services_across, union_logs
from sparklog.plans.registry import (
    SQL_LABEL,
    SQL_LOGS,
    SQL_SHOWN,
    from_docs,
    from_logs,
    registered,
    shown,
    sql_rfc3339,
)
from sparklog.session import scratch_path
from sparklog.sources.driver_tables import (
    INGEST_NS,
    logs_from_conversations,
    logs_from_documents,
    logs_from_events,
    table,
)

SINCE, UNTIL = "2024-01-10T06:30:00Z", "2024-01-20T18:00:00.5Z"
SINCE_NS, UNTIL_NS = to_ns(SINCE), to_ns(UNTIL)
DAY_NS = 86_400_000_000_000
NEWEST = "ORDER BY time_ns DESC, record_id LIMIT"


@registered(
    from_logs(f"""SELECT {SQL_SHOWN} FROM logs WHERE service IN ('app-error', 'app-purchase') AND severity >= 13
    AND time_ns >= {SINCE_NS} AND time_ns < {UNTIL_NS} {NEWEST} 100""")
)
def structured_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_from_events(spark, sf_dir)
    services = ["app-error", "app-purchase"]
    return shown(q.query_logs(logs, services=services, min_severity="WARN", since=SINCE, until=UNTIL))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs {NEWEST} 100"))
def query_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(q.query_logs(logs_from_events(spark, sf_dir)))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs WHERE service IN ('app-click', 'app-view')"))
def query_service_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(q.filter_logs(logs_from_events(spark, sf_dir), services=["app-click", "app-view"]))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs WHERE severity >= 13"))
def query_min_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(q.filter_logs(logs_from_events(spark, sf_dir), min_severity="warning"))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs WHERE time_ns >= {SINCE_NS} AND time_ns < {UNTIL_NS}"))
def query_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(q.filter_logs(logs_from_events(spark, sf_dir), since=SINCE, until=UNTIL))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs WHERE time_ns >= {INGEST_NS - 7 * DAY_NS}"))
def query_time_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(q.filter_logs(logs_from_events(spark, sf_dir), since="7d", now_ns=INGEST_NS))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs WHERE time_ns >= {to_ns('2030-01-01T00:00:00Z')} {NEWEST} 100"))
def query_no_day_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(q.query_logs(logs_from_events(spark, sf_dir), since="2030-01-01T00:00:00Z"))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs {NEWEST} 1000"))
def limit_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(q.query_logs(logs_from_events(spark, sf_dir), limit=99_999))


@registered(
    from_logs(f"""SELECT {SQL_SHOWN} FROM logs WHERE severity >= 5 AND (time_ns < {SINCE_NS}
    OR (time_ns = {SINCE_NS} AND record_id > '000000000000')) {NEWEST} 50""")
)
def page_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = (SINCE_NS, "000000000000")
    return shown(q.query_logs(logs_from_events(spark, sf_dir), min_severity="DEBUG", after=after, limit=50))


@registered(
    from_logs("""SELECT record_id, time_ns, CAST(CASE WHEN user_id % 5 = 0 THEN 3 ELSE 1 END AS BIGINT) AS copies
    FROM logs WHERE severity >= 17""")
)
def pages_join_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a query one after the other; every fifth user's rows are there three times, alike to the byte."""
    logs = logs_from_events(spark, sf_dir)
    repeated = logs.where(F.col("user_id") % 5 == 0)
    logs = logs.unionByName(repeated).unionByName(repeated)
    # The first and the last page by themselves, those in between from the cursor of the first in one pass.
    pages, between = [paging.page_logs(logs, 997, min_severity="ERROR")], []
    cursor = pages[0].next_cursor
    if cursor:
        following, ends = paging.following_pages(logs, 997, cursor, min_severity="ERROR")
        last = ends.orderBy(F.desc("page")).first()
        if last is not None:
            between.append(following.where(F.col("page") <= last.page).drop("page"))
            cursor = last.next_cursor
    while cursor:
        pages.append(paging.page_logs(logs, 997, cursor, min_severity="ERROR"))
        cursor = pages[-1].next_cursor
    rows = union_logs([*(page.rows for page in pages), *between])
    return rows.groupBy("record_id", "time_ns").agg(F.count("*").alias("copies"))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs WHERE trace = md5('7')"))
def trace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seven = "8f14e45fceea167a5a36dedd4bea2543"
    return shown(q.filter_logs(logs_from_events(spark, sf_dir), trace_id=seven))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs WHERE json_extract_string(attrs_json, '$.k') = '5'"))
def attr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(q.filter_logs(logs_from_events(spark, sf_dir), attributes={"k": "5"}))


@registered(
    from_logs(f"""SELECT record_id, time_ns, '{{"time":"' || {sql_rfc3339('time_ns')} || '","ingest":"' ||
    {sql_rfc3339('ingest_ns')} || '","severity":"' || {SQL_LABEL} || '","service":"' || service ||
    '","instance":"' || instance || '","logger":"' || logger || '","trace_id":"' || trace || '","message":"' ||
    message || '","attrs":' || replace(attrs_json, ' ', '') || '}}' AS record FROM logs""")
)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.to_json_records(logs_from_events(spark, sf_dir))


@registered(
    from_logs(f"""SELECT {SQL_SHOWN} FROM logs WHERE severity >= 17 AND time_ns >= {INGEST_NS - DAY_NS} {NEWEST} 50""")
)
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(q.recent_errors(logs_from_events(spark, sf_dir), INGEST_NS, "24h"))


@registered(
    from_logs(f"""SELECT least(count(*), 10000) AS count_total_estimate FROM logs
    WHERE time_ns >= {SINCE_NS} AND time_ns < {UNTIL_NS}""")
)
def count_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.count_capped(q.filter_logs(logs_from_events(spark, sf_dir), since=SINCE, until=UNTIL))


@registered(from_logs(f"SELECT {SQL_SHOWN} FROM logs WHERE trace = md5('3') ORDER BY trace, time_ns, record_id"))
def correlate_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = "eccbc87e4b5ce2fe28308fd9f2a7baf3"
    return shown(correlation.correlate(logs_from_events(spark, sf_dir), three))


@registered(
    from_logs(f"""SELECT {SQL_SHOWN} FROM logs WHERE trace IN
    (SELECT trace FROM logs WHERE severity >= 17 AND json_extract_string(attrs_json, '$.k') = '13')""")
)
def correlate_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_from_events(spark, sf_dir)
    failing = q.filter_logs(logs, min_severity="ERROR", attributes={"k": "13"})
    return shown(correlation.correlate(logs, failing))


@registered(
    """SELECT conv_id, turn, role AS service, text AS message FROM conversations
    WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')"""
)
def correlate_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = logs_from_conversations(spark, sf_dir)
    found = correlation.correlate(turns, turns.where(F.col("service") == "system"))
    return found.select("conv_id", "turn", "service", "message")


# --- search over whole document texts; the folded text is " word word " on both sides ---
FOLDED = r"' ' || regexp_replace(strip_accents(lower(message)), '[^\p{L}\p{N}]+', ' ', 'g') || ' '"


def _search_sql(condition: str) -> str:
    return from_docs(
        f", folded AS (SELECT doc_id, {FOLDED} AS t FROM docs) SELECT doc_id FROM folded WHERE {condition}"
    )


def _hits(spark: SparkSession, sf_dir: str, match) -> DataFrame:
    return q.filter_logs(logs_from_documents(spark, sf_dir), text=match).select("doc_id")


@registered(_search_sql("contains(t, ' with ')"))
def search_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, term("WITH"))


@registered(_search_sql("contains(t, ' meme ')"))
def search_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, term("même"))


@registered(_search_sql("contains(t, ' etre ') OR contains(t, ' uber ')"))
def search_accents_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, term("Être") | term("ÜBER"))


@registered(_search_sql("contains(t, ' of the ')"))
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, phrase("of the"))


@registered(_search_sql("contains(t, ' tok')"))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, prefix("tok"))


@registered(
    _search_sql("(contains(t, ' und ') OR contains(t, ' that ')) AND contains(t, ' in ') AND NOT contains(t, ' der ')")
)
def search_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, (term("und") | term("that")) & term("in") & ~term("der"))


@registered(
    _search_sql(
        r"""regexp_matches(t, ' by ([^ ]+ ){0,3}with ') OR regexp_matches(t, ' with ([^ ]+ ){0,3}by ')"""
    )
)
def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, near("by", "with", distance=3))


@registered(
    from_docs(
        f""", folded AS (SELECT record_id, doc_id, time_ns, {FOLDED} AS t FROM docs)
    SELECT record_id, doc_id, time_ns FROM folded WHERE contains(t, ' the ') {NEWEST} 100"""
    )
)
def search_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_from_documents(spark, sf_dir)
    match = term("the")
    found = q.newest(q.filter_logs(logs, text=match).select("record_id", "doc_id", "time_ns"))
    return found


@registered(
    from_docs(
        f""", folded AS (SELECT doc_id, {FOLDED} AS t FROM docs), words AS (
      SELECT doc_id, list_filter(string_split(t, ' '), lambda w: w <> '') AS w FROM folded)
    SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words FROM words"""
    )
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = logs_from_documents(spark, sf_dir).select("doc_id", tokens(F.col("message")).alias("w"))
    return words.select(
        "doc_id",
        F.size("w").cast("bigint").alias("words"),
        F.size(F.array_distinct("w")).cast("bigint").alias("distinct_words"),
    )


@registered(_search_sql("contains(t, ' the ') AND contains(t, ' with ') AND contains(t, ' by ')"))
def search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_from_documents(spark, sf_dir)
    path = scratch_path(spark, "token-index")
    search.write_token_index(logs, path)
    return search.search_with_index(logs, spark.read.parquet(path), ["the", "with", "by"]).select("doc_id")


def _by_positions(spark: SparkSession, sf_dir: str, match) -> DataFrame:
    """Records found by an index of positions; the rows that are joined to it have no message."""
    logs = logs_from_documents(spark, sf_dir)
    path = scratch_path(spark, "position-index")
    position_index.write_position_index(logs, path)
    slim = logs.select("day", "record_id", "doc_id")
    return position_index.search_positions(slim, spark.read.parquet(path), match).select("doc_id")


@registered(_search_sql("contains(t, ' of the ')"))
def search_index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_positions(spark, sf_dir, phrase("Of THE"))


@registered(_search_sql("contains(t, ' in tha')"))
def search_index_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_positions(spark, sf_dir, prefix("in tha"))


@registered(_search_sql("contains(t, ' la ') AND NOT (contains(t, ' etre ') OR contains(t, ' de la '))"))
def search_index_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_positions(spark, sf_dir, term("la") & ~(term("être") | phrase("de la")))


@registered(_search_sql("NOT (contains(t, ' und ') AND contains(t, ' der ')) OR contains(t, ' schen ')"))
def search_index_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_positions(spark, sf_dir, ~(term("und") & term("der")) | term("schen"))


@registered(
    _search_sql(r"""regexp_matches(t, ' by ([^ ]+ ){0,3}with ') OR regexp_matches(t, ' with ([^ ]+ ){0,3}by ')""")
)
def search_index_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_positions(spark, sf_dir, near("by", "with", distance=3))


@registered(
    f"""WITH {SQL_LOGS} SELECT service FROM logs UNION SELECT source AS service FROM documents
    UNION SELECT role AS service FROM conversations"""
)
def services_across_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [logs_from_events, logs_from_documents, logs_from_conversations]
    return distinct_services_across([source(spark, sf_dir) for source in sources])


@registered(
    f"""WITH {SQL_LOGS}, everything AS (
      SELECT service, logger FROM logs UNION ALL SELECT source, NULL FROM documents
      UNION ALL SELECT role, NULL FROM conversations)
    SELECT service, count(*) AS records, count(logger) AS with_logger FROM everything GROUP BY service"""
)
def union_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [logs_from_events, logs_from_documents, logs_from_conversations]
    rows = union_logs([source(spark, sf_dir) for source in sources])
    return rows.groupBy("service").agg(F.count("*").alias("records"), F.count("logger").alias("with_logger"))


@registered(
    from_logs("""SELECT record_id, time_ns, coalesce(n_name, service) AS service
    FROM logs LEFT JOIN nation ON user_id % 30 = n_nationkey""")
)
def attribution_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("ingest_key"), F.col("n_name").alias("service")
    )
    logs = logs_from_events(spark, sf_dir).withColumn("ingest_key", F.col("user_id") % 30)
    return pin_service(logs, owners).select("record_id", "time_ns", "service")
