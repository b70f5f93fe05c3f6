"""Message search: a scan with a word predicate, or an index table of words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.functions.tokens import Match, check_word, tokens
from sparklog.operators.query import query_logs


def search_logs(df: DataFrame, match: Match, limit: int | None = None, clamp: bool = True, **filters) -> DataFrame:
    """Newest rows whose message passes ``match``, within the other filters."""
    return query_logs(df, text=match, limit=limit, clamp=clamp, **filters)


def token_index(df: DataFrame) -> DataFrame:
    """(day, token, record_id), one row per distinct word of a record. No shuffle."""
    return df.select(
        "day", "record_id", F.explode(F.array_distinct(tokens(F.col("message")))).alias("token")
    )


def write_token_index(df: DataFrame, path: str) -> None:
    """Index table by day, ranged on (token, record_id): a common word spans many files, and
    the min/max of a file's tokens let a lookup skip the others."""
    (
        token_index(df)
        .repartitionByRange("day", "token", "record_id")
        .sortWithinPartitions("day", "token", "record_id")
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )


def search_index(index: DataFrame, words: list[str]) -> DataFrame:
    """record_ids holding every word. Joined to the log table it gives the rows."""
    wanted = sorted({check_word(w) for w in words})
    hits = index.where(F.col("token").isin(wanted))
    if len(wanted) == 1:
        return hits.select("day", "record_id")
    # Grouped by record, never by word, so a word found in a third of all rows does no harm.
    grouped = hits.groupBy("day", "record_id").agg(F.count("*").alias("found"))
    return grouped.where(F.col("found") == len(wanted)).select("day", "record_id")


def search_with_index(df: DataFrame, index: DataFrame, words: list[str]) -> DataFrame:
    return df.join(search_index(index, words), ["day", "record_id"], "left_semi")


def any_of(matches: list[Match]) -> Match:
    return reduce(lambda a, b: a | b, matches)


def all_of(matches: list[Match]) -> Match:
    return reduce(lambda a, b: a & b, matches)
