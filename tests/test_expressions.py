from __future__ import annotations

import datetime as dt
import random
import sqlite3
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparklog.functions import anyvalue, ids, severity, text, times, tokens


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_severity_labels(spark):
    numbers = [0, 1, 5, 9, 13, 17, 21, 3, 12, 16, 20, 24, 25, -4]
    labels = "UNSPECIFIED TRACE DEBUG INFO WARN ERROR FATAL TRACE INFO WARN ERROR FATAL FATAL UNSPECIFIED".split()
    assert column(spark, numbers, "int", severity.severity_label) == labels


def test_severity_from_label(spark):
    spelled = ["ERROR", "error", "WARN", "warning", "", "invalid", "Error", "WARNING", "fatal"]
    assert column(spark, spelled, "string", severity.severity_from_label) == [17, 17, 13, 13, 0, 0, 0, 13, 21]


def test_read_severity(spark):
    written = ["17", "ERROR", "-3", "1.5", "99999999999", "nope"]
    assert column(spark, written, "string", severity.read_severity) == [17, 17, -3, None, None, 0]


def test_otlp_severity(spark):
    written = ["9", "SEVERITY_NUMBER_WARN2", "SEVERITY_NUMBER_FATAL4", "SEVERITY_NUMBER_UNSPECIFIED", "WARN"]
    assert column(spark, written, "string", severity.otlp_severity) == [9, 14, 24, 0, None]


def test_severity_argument():
    assert [severity.severity_value(v) for v in ("WARN", "17", 5, None, "")] == [13, 17, 5, 0, 0]
    for bad in ("not-a-thing", "Error", "UNSPECIFIED", 2**31):
        with pytest.raises(ValueError):
            severity.severity_value(bad)


def test_ids(spark):
    sent = ["aabbccdd112233445566778899001122", "AABBCCDD112233445566778899001122", "zz" * 16, "aabbcc", ""]
    read = column(spark, sent, "string", lambda c: ids.hex_id(ids.parse_hex_id(c, 16)))
    assert read == [sent[0], sent[0], None, None, None]
    base64 = column(spark, ["AQIDBAUGBwg=", "AQI=", "%%"], "string", lambda c: ids.hex_id(ids.decode_id(c, 8, "base64")))
    assert base64 == ["0102030405060708", None, None]


def test_rfc3339(spark):
    stamps = [0, 1, 1_500_000_000, 1_776_081_600_000_000_000, -1, -86_400_000_000_000, 1_700_000_000_120_000_000]
    assert column(spark, stamps, "long", times.rfc3339_nano) == [
        "1970-01-01T00:00:00Z",
        "1970-01-01T00:00:00.000000001Z",
        "1970-01-01T00:00:01.5Z",
        "2026-04-13T12:00:00Z",
        "1969-12-31T23:59:59.999999999Z",
        "1969-12-31T00:00:00Z",
        "2023-11-14T22:13:20.12Z",
    ]


def test_utc_day_ignores_client_zone(spark):
    early, late = times.to_ns("2026-04-13T00:30:00-04:00"), times.to_ns("2026-04-13T22:00:00-04:00")
    days = column(spark, [early, late], "long", times.utc_day)
    assert days == [dt.date(2026, 4, 13), dt.date(2026, 4, 14)]


def test_time_arguments():
    assert times.to_ns("1970-01-01T00:00:01.000000002Z") == 1_000_000_002
    assert times.to_ns("1970-01-01T02:00:00+02:00") == 0
    assert times.to_ns(dt.datetime(1970, 1, 1, 0, 0, 1, tzinfo=dt.timezone.utc)) == 1_000_000_000
    assert times.to_ns("1h", 3_600_000_000_000) == 0
    for bad in ("yesterday", "2026-04-13", "2026-04-13T12:00:00", "1h"):
        with pytest.raises(ValueError):
            times.to_ns(bad)


def test_preview(spark):
    assert column(spark, ["a" * 200, "é" * 201], "string", text.preview) == ["a" * 200, "é" * 200 + "..."]


def test_strip_ansi(spark):
    assert column(spark, ["\x1b[31mred\x1b[0m", "plain [0m"], "string", text.strip_ansi) == ["red", "plain [0m"]


def test_cut_bytes(spark):
    long = ["é" * 40, "a" + "é" * 40, "a" * 64, "𝄞" * 20, "ab𝄞" * 20]
    got = column(spark, long, "string", lambda c: text.cut_bytes(c, 63))
    wanted = [s.encode()[:63].decode(errors="ignore") for s in long]
    assert got == wanted


def test_redact(spark):
    lines = [
        "GET /v?key=abc123&x=1",
        "Authorization: Bearer tok.en",
        'token = "deadbeef"',
        "Cookie: a=b; c=d",
        "nothing here",
    ]
    assert column(spark, lines, "string", text.redact) == [
        "GET /v?key=***&x=1",
        "Authorization: Bearer ***",
        'token = "***"',
        "Cookie: ***",
        "nothing here",
    ]


def test_double_text(spark):
    def general(x):
        """Shortest digits, exponent below -4 or from 6 on."""
        digits = repr(x)
        sign = "-" if digits.startswith("-") else ""
        _, figures, shift = Decimal(digits).as_tuple()
        figures = "".join(map(str, figures)).rstrip("0") or "0"
        exponent = Decimal(digits).adjusted()
        if exponent < -4 or exponent >= 6:
            mantissa = figures[0] + ("." + figures[1:] if len(figures) > 1 else "")
            return f"{sign}{mantissa}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
        plain = format(Decimal(digits), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain

    rnd = random.Random(3)
    numbers = [1e6, 1234567.8, 123456.7, 1e-4, 1.5e-4, -1.5e-4, 1e-5, 1e21, 9999999.0, 1e7, -2.5e6, 0.001, 100.0]
    numbers += [rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randint(-8, 12) for _ in range(300)]
    got = column(spark, numbers, "double", lambda c: F.expr(anyvalue.format_double("v")))
    wrong = [(x, g, general(x)) for x, g in zip(numbers, got) if float(g) != x or ("e" in g) != ("e" in general(x))]
    assert wrong == []
    special = column(spark, [0.0, float("nan"), float("inf"), float("-inf")], "double", lambda c: F.expr(anyvalue.format_double("v")))
    assert special == ["0", "NaN", "+Inf", "-Inf"]


MESSAGES = [
    "upload worker disconnected",
    "Café déjà vu: the CAFE is closed",
    "user_id=42 failed; retry in 5s",
    "one two three four five six seven two one",
    "étude ́leading mark",
    "x" * 50 + " tail",
    "",
    "snake_case and kebab-case, CamelCase",
    "été ETE eté",
    "two one two",
]


@pytest.mark.parametrize(
    ("match", "fts"),
    [
        (tokens.term("worker"), "worker"),
        (tokens.term("cafe"), "cafe"),
        (tokens.term("CAFÉ"), "cafe"),
        (tokens.term("deja"), "deja"),
        (tokens.term("id"), "id"),
        (tokens.term("case"), "case"),
        (tokens.term("etude"), "etude"),
        (tokens.term("tude"), "tude"),
        (tokens.term("leading"), "leading"),
        (tokens.term("ete"), "ete"),
        (tokens.phrase("the cafe"), '"the cafe"'),
        (tokens.phrase("user id 42"), '"user id 42"'),
        (tokens.prefix("uplo"), "uplo*"),
        (tokens.prefix("de"), "de*"),
        (tokens.term("two") & ~tokens.term("three"), "two NOT three"),
        (tokens.term("worker") | tokens.term("retry"), "worker OR retry"),
        (tokens.term("one") & tokens.term("two"), "one AND two"),
        (tokens.near("one", "five", distance=3), "NEAR(one five, 3)"),
        (tokens.near("one", "five", distance=2), "NEAR(one five, 2)"),
        (tokens.near("seven", "four five", distance=1), 'NEAR(seven "four five", 1)'),
        (tokens.near("seven", "four five", distance=0), 'NEAR(seven "four five", 0)'),
        (tokens.near("two", "four", "six", distance=3), "NEAR(two four six, 3)"),
        (tokens.near("two", "four", "six", distance=2), "NEAR(two four six, 2)"),
    ],
)
def test_matches_like_a_full_text_index(spark, match, fts):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(message)")
    db.executemany("INSERT INTO t(rowid, message) VALUES (?, ?)", list(enumerate(MESSAGES)))
    wanted = {row[0] for row in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (fts,))}
    hits = column(spark, MESSAGES, "string", match.on)
    assert {i for i, hit in enumerate(hits) if hit} == wanted


def test_no_word_to_search():
    with pytest.raises(ValueError):
        tokens.term("--")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeéÈ _-.9ßñ́XII"), max_size=14), min_size=20, max_size=20))
def test_tokens_agree_with_matching(spark, messages):
    found = column(spark, messages, "string", tokens.tokens)
    for word in {w for words in found for w in words}:
        hits = column(spark, messages, "string", tokens.term(word).on)
        assert hits == [word in words for words in found]
