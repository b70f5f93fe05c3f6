"""Token counts against the tokenizer library, whatever the table and the caches hold."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparklog.llm import token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def spec():
    with open(FILE, encoding="utf-8") as file:
        return file.read()


def counted(docs, spec, **options):
    rows = token_counts.token_counts(docs, spec, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows), key=str)


def expected(docs, limit=1024):
    library = Tokenizer.from_file(FILE)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    sizes = [len(library.encode(text, add_special_tokens=False).ids) for _, text in rows]
    return sorted(((i, len(text.encode()), n, n > limit) for (i, text), n in zip(rows, sizes, strict=True)), key=str)


@pytest.fixture(scope="module")
def strange(spark):
    """Special strings, white space of all kinds, characters that two versions of Unicode may class otherwise."""
    draw = random.Random(3)
    chars = [chr(c) for c in (*range(0, 0x300), 0x180E, 0x2028, 0x3000, 0x1E900, 0x1F600, 0x16EA0, 0x11F04, 0x1DF2B, 0x31350, 0xAC00, 0x0E01, 0x0669)]
    texts = ["".join(draw.choices(chars, k=draw.randrange(1, 60))) for _ in range(300)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's  we'll\n\n x 'S", " ", "\t \n", "", "x" * 20_000, "ab " * 3000]
    return spark.createDataFrame([*enumerate(texts), (None, "no id"), (3, None)], "doc_id long, text string")


@pytest.mark.parametrize("rows", [1, 50, token_counts.TABLE_ROWS])
def test_counts_are_the_librarys(strange, spec, rows, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ROWS", 20)
    monkeypatch.setattr(token_counts, "PIECES", 7)
    assert counted(strange, spec, rows=rows) == expected(strange)


def test_whole_table(spark, small, spec):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert counted(docs, spec, limit=300) == expected(docs, 300)


def test_awkward_rows(awkward, nothing, spec):
    assert counted(awkward, spec) == expected(awkward)
    assert counted(nothing, spec) == []


def test_summary_keeps_frequent_pieces():
    """A piece with more than 1/rows of all occurrences is in every merged summary."""
    draw = random.Random(1)
    parts = [["common"] * 30 + [f"r{draw.randrange(10**6)}" for _ in range(100)] for _ in range(20)]
    total: dict[str, int] = {}
    for part in parts:
        own: dict[str, int] = {}
        for piece in part:
            own[piece] = own.get(piece, 0) + 1
        for piece, n in token_counts.pruned(own, 8).items():
            total[piece] = total.get(piece, 0) + n
        total = token_counts.pruned(total, 8)
        assert len(total) <= 8
    assert max(total, key=total.get) == "common"


def test_summaries_merge_over_many_tasks(spark, small, spec, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN_IN", 3)
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(11)
    context = spark.sparkContext
    found = token_counts.frequent_pieces(docs.select("doc_id", "text"), context.broadcast(spec), 500)
    assert 0 < len(found) <= 500 and {" de", ","} & set(found)


def test_other_tokenizers_are_refused(spark, strange, spec):
    other = json.loads(spec)
    other["normalizer"] = {"type": "Lowercase"}
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.token_counts(strange, json.dumps(other))
