"""The position index against the word tests on the messages themselves."""

from __future__ import annotations

import random

import pytest
from log_fixtures import HOUR, NOW

from sparklog.functions.tokens import near, phrase, prefix, term
from sparklog.operators.position_index import search_positions, write_position_index


@pytest.fixture(scope="module")
def messages():
    draw = random.Random(2)
    words = ["alpha", "Beta", "gamma", "gammas", "über", "x1", "the", "of"]
    found = [" ".join(draw.choices(words, k=draw.randrange(12))) for _ in range(150)]
    return [*found, "", "...", "the the the of", "of the", "of, the!", "ÜBER alpha", "gam ma"]


MATCHES = {
    "term": term("Beta"),
    "accents": term("uber"),
    "phrase": phrase("of the"),
    "repeated words": phrase("the the the"),
    "long phrase": phrase("alpha beta gamma"),
    "prefix": prefix("gam"),
    "prefix after a word": prefix("the ga"),
    "prefix of a repeated word": prefix("the the"),
    "and not": term("alpha") & ~phrase("of the"),
    "or": term("x1") | phrase("beta beta"),
    "not": ~term("alpha"),
    "neither": ~term("alpha") & ~term("beta"),
    "or not": term("x1") | ~term("the"),
    "not both or": ~(term("alpha") & term("beta")) | ~term("gamma"),
    "near": near("alpha", "x1", distance=2),
    "near phrases": near("of the", "beta", distance=1),
    "near three": near("alpha", "beta", "gamma", distance=3),
    "near itself": near("the", "the of", distance=0),
    "near at no distance": near("alpha", "beta", distance=0) & prefix("g"),
    "nowhere": term("missing"),
}


@pytest.fixture(scope="module")
def indexed(spark, messages, tmp_path_factory):
    from pyspark.sql import functions as F

    from sparklog.functions.times import utc_day

    rows = [(f"r{i:04}", NOW + i * HOUR, m) for i, m in enumerate(messages)]
    logs = spark.createDataFrame(rows, "record_id string, time_ns bigint, message string").withColumn("day", utc_day(F.col("time_ns"))).cache()
    path = str(tmp_path_factory.mktemp("index") / "positions")
    write_position_index(logs, path)
    return logs, spark.read.parquet(path)


@pytest.mark.parametrize("name", MATCHES)
def test_index_agrees_with_the_message(indexed, name):
    logs, index = indexed
    match = MATCHES[name]
    slim = logs.select("day", "record_id")
    got = sorted(r.record_id for r in search_positions(slim, index, match).collect())
    assert got == sorted(r.record_id for r in logs.where(match.on(logs["message"])).collect())


def test_lookup_prunes_by_day_and_token(indexed):
    logs, index = indexed
    found = search_positions(logs.select("day", "record_id"), index.where("day = DATE '2026-04-14'"), term("alpha"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,alpha)" in plan and "message" not in plan.split("FileScan parquet")[1].split("ReadSchema")[1].split("\n")[0]
