"""Search without reading messages: an index of where each word stands.

A posting is (day, token, record_id, position), one row for each word of a message, ranged on the
token, so that the files' least and greatest tokens let a lookup skip the others, and a word that
stands in a third of all messages is spread over many files. A phrase is found by moving each word's
positions back by its place in the phrase and counting how many meet; a prefix is a range of tokens; NEAR compares positions
within a record; AND, OR and NOT are joins and unions of records. Everything is grouped by
record, never by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions.tokens import Match, tokens

_RECORD = ["day", "record_id"]
#: Sorts after every continuation of a prefix.
_LAST = "\U0010ffff"


def position_index(df: DataFrame) -> DataFrame:
    """(day, token, record_id, position) of every word, from 0. No shuffle; a message without words has none."""
    return df.select(*_RECORD, F.posexplode(tokens(F.col("message"))).alias("position", "token"))


def write_position_index(df: DataFrame, path: str) -> None:
    """The index as a table by day, ranged on (token, record_id, position)."""
    (
        position_index(df)
        .repartitionByRange("day", "token", "record_id", "position")
        .sortWithinPartitions("day", "token", "record_id", "position")
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )


def _at(word: str, whole: bool) -> Column:
    token = F.col("token")
    return token == word if whole else token.between(word, word + _LAST)


def starts(index: DataFrame, words: list[str], whole: bool = True) -> DataFrame:
    """(day, record_id, start) of each place where the words stand one after the other."""
    places = [(_at(word, whole or n < len(words) - 1), n) for n, word in enumerate(words)]
    if len(words) == 1:
        return index.where(places[0][0]).select(*_RECORD, F.col("position").alias("start"))
    wanted = places[0][0]
    for test, _ in places[1:]:
        wanted = wanted | test
    # a token may be several words of the phrase: it then counts for each of its places
    own = F.array_compact(F.array(*[F.when(test, F.lit(n)) for test, n in places]))
    moved = index.where(wanted).select(*_RECORD, "position", F.explode(own).alias("n"))
    found = moved.groupBy(*_RECORD, (F.col("position") - F.col("n")).alias("start")).agg(F.count("*").alias("met"))
    return found.where(F.col("met") == len(words)).select(*_RECORD, "start")


def _near(index: DataFrame, phrases: list[list[str]], distance: int) -> DataFrame:
    """Records where some phrase opens and every other one starts at most ``distance`` words after its end."""
    each = None
    for n, words in enumerate(phrases):
        own = starts(index, words).withColumn("n", F.lit(n))
        each = own if each is None else each.unionByName(own)
    # the places of a record are as many as its words at most
    lists = [F.collect_list(F.when(F.col("n") == n, F.col("start"))).alias(f"p{n}") for n in range(len(phrases))]
    together = each.groupBy(*_RECORD).agg(*lists)

    def opens(n: int) -> Column:
        reach = len(phrases[n]) + distance

        def close(at: Column) -> Column:
            near = F.lit(True)
            for m in range(len(phrases)):
                if m != n:
                    near = near & F.exists(f"p{m}", lambda other: other.between(at, at + reach))
            return near

        return F.exists(f"p{n}", close)

    test = opens(0)
    for n in range(1, len(phrases)):
        test = test | opens(n)
    return together.where(test).select(*_RECORD)


def _records(index: DataFrame, match: Match) -> tuple[bool, DataFrame]:
    """(True, records that match) or (False, records that do not): a set or what is outside of one."""
    kind, *parts = match.form
    if kind == "words":
        return True, starts(index, *parts).select(*_RECORD).distinct()
    if kind == "near":
        return True, _near(index, *parts)
    inside, found = _records(index, parts[0])
    if kind == "not":
        return not inside, found
    also, more = _records(index, parts[1])
    if kind == "or":  # by way of the complements
        inside, also = not inside, not also
    if inside and also:
        result = True, found.join(more, _RECORD, "left_semi")
    elif inside:
        result = True, found.join(more, _RECORD, "left_anti")
    elif also:
        result = True, more.join(found, _RECORD, "left_anti")
    else:
        result = False, found.unionByName(more).distinct()
    return (not result[0], result[1]) if kind == "or" else result


def search_positions(df: DataFrame, index: DataFrame, match: Match) -> DataFrame:
    """The rows of ``df`` whose message passes ``match``, by the index alone."""
    inside, found = _records(index, match)
    return df.join(found, _RECORD, "left_semi" if inside else "left_anti")
