"""Secrets of each kind planted among harmless look-alikes."""

from __future__ import annotations

import random
import re
import string

import pytest

from sparklog.llm import secrets
from sparklog.llm.common import texts

KINDS = {
    "short password": lambda d: ('password = "{}"', "".join(d.choices(string.ascii_lowercase, k=6)) + d.choice("!?#$%&*") + str(d.randrange(10, 99))),
    "passphrase": lambda d: ("secret={}", "".join(d.choices(["correct", "horse", "battery", "staple", "wagon", "violet"], k=4))),
    "address": lambda d: ("postgres://user:{}@db.internal/app", "".join(d.choices(string.ascii_letters + string.digits, k=8))),
    "dotted": lambda d: ("got {} from it", ".".join("".join(d.choices(string.ascii_letters + string.digits, k=9)) + "7" for _ in range(3))),
    "letters": lambda d: ("the key {} was seen", "".join(d.choices(string.ascii_letters, k=32))),
    "hex": lambda d: ("token: {}", "".join(d.choices("0123456789abcdef", k=40))),
    "provider": lambda d: ("use {} here", "ghp_" + "".join(d.choices(string.ascii_letters + string.digits, k=36))),
    "with signs": lambda d: ("api_key: '{}'", "".join(d.choices(string.ascii_letters + string.digits, k=5)) + "@" + "".join(d.choices(string.digits, k=4)) + "~x"),
}
HARMLESS = ["see /usr/local/lib/python3/site-packages/module12/file", "order number 123456789012345", "mail john.smith1234567@example.com", "password: required", "token: missing", "the secret: patience", "files/2024/01/report-final-version2"]
FILLER = "the report says that the required patience of the river is missing from every page of this long and harmless book".split()


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(9)
    rows, wanted = [], {}
    for i in range(400):
        words = draw.choices(FILLER, k=40)
        if i % 2:
            kind = list(KINDS)[i // 2 % len(KINDS)]
            form, value = KINDS[kind](draw)
            text = " ".join(words[:20]) + " " + form.format(value) + " " + " ".join(words[20:])
            wanted[i] = (kind, text.index(value), text.index(value) + len(value))
        else:
            text = " ".join([*words[:20], draw.choice(HARMLESS), *words[20:]])
        rows.append((i, text))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), wanted


def test_every_kind_is_a_candidate(planted):
    docs, wanted = planted
    found = {(r.doc_id, r.start, r.end) for r in secrets.candidates(texts(docs)).collect()}
    assert [(i, kind) for i, (kind, start, end) in wanted.items() if (i, start, end) not in found] == []


def test_recall_by_kind_and_precision(planted):
    docs, wanted = planted
    rows = {r.doc_id: r for r in secrets.scan(docs).collect()}
    spans = {i: [tuple(map(int, span.split(":")[:2])) for span in r.spans.split(",") if span] for i, r in rows.items()}
    hits = {kind: [] for kind in KINDS}
    for i, (kind, start, end) in wanted.items():
        hits[kind].append((start, end) in spans[i])
    recall = {kind: sum(h) / len(h) for kind, h in hits.items()}
    assert min(recall.values()) >= 0.9, recall
    wrong = sum(rows[i].n_secrets > 0 for i in rows if i not in wanted)
    assert wrong <= 0.1 * (len(rows) - len(wanted))


def test_candidates_by_the_patterns_themselves(spark, small, documents):
    """Places and texts of all candidates of a whole table, found text by text."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    run, value = (re.compile(p.replace("*+", "*").replace("}+", "}")) for p in (secrets.RUN, secrets.VALUE))
    wanted = set()
    for i, text in documents.items():
        values = [m.span(m.lastindex) for m in value.finditer(text or "")]
        runs = [m.span() for m in run.finditer(text or "")]
        runs = [(a, b) for a, b in runs if not any(c < b and d > a for c, d in values)]
        wanted |= {(i, a, b, text[a:b]) for a, b in [*values, *runs]}
    got = {(r.doc_id, r.start, r.end, r.candidate) for r in secrets.candidates(texts(docs)).collect()}
    assert got == wanted and len(got) > 5
