"""Token alignment against sets of ends, group by group."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparklog.llm import token_alignment

FILE_A, FILE_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def files():
    with open(FILE_A, encoding="utf-8") as a, open(FILE_B, "rb") as b:
        return a.read(), b.read()


@pytest.fixture(scope="module")
def tables(files):
    own = token_alignment.Tokenizers(*files)
    assert own.lanes
    return own.bytes_a, own.bytes_b


@cache
def libraries():
    a = Tokenizer.from_file(FILE_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILE_B)


def brute_groups(text, tables):
    """Groups of (A ids, B ids) of a text encoded as a whole; none if the bytes differ."""
    a_library, b_library = libraries()
    a, b = a_library.encode(" " + text, add_special_tokens=False).ids, b_library.encode(text)
    ends = []
    for ids, table in zip((a, b), tables, strict=True):
        at, own = 0, []
        if b"".join(table[k] for k in ids) != b" " + text.encode():
            return []
        for k in ids:
            at += len(table[k])
            own.append(at)
        ends.append(own)
    groups, at = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        group = ([], [])
        for k, ids in enumerate((a, b)):
            while at[k] < len(ids) and ends[k][at[k]] <= cut:
                group[k].append(ids[at[k]])
                at[k] += 1
        groups.append(group)
    return groups


def brute(rows, tables):
    documents, count = [], Counter()
    for doc_id, text in rows:
        groups = brute_groups(text, tables) if text else []
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        count.update(links.keys())
        documents.append((doc_id, groups, links))
    highest: dict[int, int] = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    found = []
    for doc_id, groups, links in documents:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sizes = (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()))
        best = sum(n for p, n in links.items() if count[p] == highest[p[0]])
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        found.append((doc_id, *sizes, best, sum(n * count[p] for p, n in links.items()), digest))
    return sorted(found, key=str)


def aligned(docs, files, **options):
    return sorted(map(tuple, token_alignment.alignment(docs, *files, **options).collect()), key=str)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("frequent", [0, 2000, token_alignment.FREQUENT])
def test_whole_table(spark, small, files, tables, frequent):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert aligned(docs, files, frequent=frequent) == brute(pairs_of(docs), tables)


@pytest.fixture(scope="module")
def strange(spark):
    texts = [
        "a▁b", "<|endoftext|> and <s> and <0x41>", "\x00 \x01", "  two  spaces   three", " ", "\n\n", "  x", "日本語のテキスト、句読点。",
        "\U0001f600" * 50, "=" * 5000, "ab" * 3000 + " " + "é" * 900, "mixed ́ marks é " * 80, "word " * 700, "e=mc² — “quoted” … " * 60, "Ünï cödé " * 300,
        "it's we'll  I'd 'S", "tab\tand\r\nlines", "0123456789" * 200, "A" * 3000, "x", "",
        "a\U00016ea0b1\U0001e900! \u180ex \x1c\x85\u2028\U00031350 \U0001df2ba \U00011f04's \u0e01\u0e33 1\u0669\u00b2" * 30, "z" * 20_000,
    ]
    return spark.createDataFrame([*enumerate(texts), (None, "no id"), (3, None), (18, "A" * 3000)], "doc_id long, text string")


@pytest.mark.parametrize(("wide", "lane"), [(token_alignment.WIDE, token_alignment.LANE_CHARS), (1, 8), (10**9, 10**9)])
def test_strange_texts(strange, files, tables, wide, lane, monkeypatch):
    """Lanes and wide groups change nothing; a text whose bytes do not come back has no tokens."""
    monkeypatch.setattr(token_alignment, "WIDE", wide)
    monkeypatch.setattr(token_alignment, "LANE_CHARS", lane)
    monkeypatch.setattr(token_alignment, "SLICE_CHARS", 500)
    got = aligned(strange, files)
    assert got == brute(pairs_of(strange), tables)
    assert [r[1:] for r in got if r[0] == 0] == [(0, 0, 0, 0, 0, 0, "")]


def test_awkward_rows(awkward, nothing, files, tables):
    assert aligned(awkward, files) == brute(pairs_of(awkward), tables)
    assert aligned(nothing, files) == []


def test_listing_and_link_table(spark, files, tables):
    docs = spark.createDataFrame([(1, "tokens align"), (2, "tokens")], "doc_id long, text string")
    rows = token_alignment.aligned(docs, spark.sparkContext.broadcast(files), with_groups=True)
    shown = {r.doc_id: r.groups for r in rows.collect()}
    for doc_id, text in ((1, "tokens align"), (2, "tokens")):
        assert shown[doc_id] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute_groups(text, tables))
    counts = {(r.a, r.b): (r.n, r.best) for r in token_alignment.link_table(rows, len(tables[1])).collect()}
    first = brute_groups("tokens", tables)[0]
    assert counts[first[0][0], first[1][0]] == (2, True) and min(n for n, _ in counts.values()) == 1
