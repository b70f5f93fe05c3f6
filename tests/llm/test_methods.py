"""Results against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparklog.llm import bpe, fm_index, jaccard_join, license_rules, license_scan, pii, simhash
from sparklog.llm.queries import QUERIES, byte_vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(frame):
    return {row.doc_id: row for row in frame.collect()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def groups(sets):
    """Smallest reachable id of each id, by comparing every pair that shares a shingle."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        for other in {o for s in sets[i] for o in holders[s]}:
            both = len(sets[i] & sets[other])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[other]) - both):
                a, b = sorted((find(i), find(other)))
                root[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: find(i) for i in sets}


def test_jaccard_join(spark, small, documents):
    got = by_id(QUERIES["op1_jaccard_join"](spark, small))
    sets = {i: shingles(t) for i, t in documents.items()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), c) for i, c in groups(sets).items()}


@pytest.mark.parametrize("least, pivot", [(24, 64), (1, 3)])
def test_jaccard_join_of_edited_copies(spark, monkeypatch, least, pivot):
    """Families of copies with growing edits, with tokens frequent and rare, groups small and large."""
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", least)
    monkeypatch.setattr(jaccard_join, "PIVOT_SIZE", pivot)
    draw, docs = random.Random(5), {}
    for family in range(6):
        base = [f"f{family}w{draw.randrange(900)}" for _ in range(draw.choice([4, 5, 8, 9, 40, 150]))]
        for _ in range(12):
            words = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
            docs[len(docs)] = " ".join(words + ["shared"] * draw.randrange(2))
    got = by_id(jaccard_join.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == groups({i: shingles(t) for i, t in docs.items()})


@pytest.mark.parametrize("rounds", [0, 3])
def test_jaccard_join_of_copies_far_from_each_other(spark, monkeypatch, rounds):
    """Copies of one text, many linked to nothing or only to a twin that is as far from the text: no pivot settles them."""
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", 1)
    monkeypatch.setattr(jaccard_join, "PIVOT_SIZE", 4)
    if not rounds:  # not even the text itself is in a component before the last step
        monkeypatch.setattr(jaccard_join, "pivot_pairs", lambda large: large.select(*[large.node.alias(name) for name in "ab"]).where("a <> b"))
    draw, texts = random.Random(9), []
    base = [f"w{draw.randrange(10**6)}" for _ in range(130)]

    def edited(words, edits):
        words = list(words)
        for at in draw.sample(range(len(words)), edits):
            words[at] = f"x{draw.randrange(10**6)}"
        return words

    for edits in [1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9] * 5:
        copy = edited(base, edits)
        texts += [copy] if edits < 6 else [copy, edited(copy, draw.choice([1, 2, 3]))]
    draw.shuffle(texts)
    docs = dict(enumerate(" ".join(words) for words in texts))
    expected = groups({i: shingles(t) for i, t in docs.items()})
    assert len(set(expected.values())) > 10
    found, apart = [], jaccard_join.apart

    def counted(placed, sets):
        found.append(apart(placed, sets))
        return found[-1]

    monkeypatch.setattr(jaccard_join, "apart", counted)
    rows = jaccard_join.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert len(found) == 1 and found[0].count() < len(docs) * 4


def test_differences_within_one_component_are_not_joined(spark, monkeypatch):
    """Tokens that only nodes of one component hold beside a pivot give no pair and take no part in the join."""
    kept, stored = {}, jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    base = set(range(1000, 1100))
    sets = {1: base, 2: base - {1000} | {1, 3}, 3: base - {1001} | {1, 2}, 4: base - {1002} | {2, 5}}
    rows = [(node, np.array(sorted(tokens), np.uint64).tobytes()) for node, tokens in sets.items()]
    placed = [(node, 1, len(sets[node]), 4 if node == 4 else 2) for node in (2, 3, 4)]
    found = jaccard_join.apart(spark.createDataFrame(placed, "node long, pivot long, n long, label long"), spark.createDataFrame(rows, "node long, tokens binary"))
    assert {(r.a, r.b) for r in found.collect()} == {(3, 4)}
    assert {(r.node, r.token) for r in kept["prefixes"].collect()} == {(3, 2), (4, 2)}


def test_signatures_meet(monkeypatch):
    """Any two sets at the threshold share a signature, whatever is frequent."""
    draw = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.8, 1.0):
        frequent = draw.random(jaccard_join.COUNTERS) < share
        for _ in range(300):
            n = int(draw.integers(4, 120))
            x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
            y = x[draw.random(len(x)) > 0.12]
            y = np.unique(np.concatenate([y, draw.integers(0, 2**63, int(draw.integers(0, 4))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) >= 4 and 100 * both >= 80 * (len(x) + len(y) - both):
                a, b = (jaccard_join.signatures(s, frequent)[0] for s in (x, y))
                assert len(np.intersect1d(a, b)), (share, len(x), len(y), both)


def test_pii_base(spark, small, documents):
    got = by_id(QUERIES["op2_pii"](spark, small))
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        luhn = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in found.split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    texts = dict(documents) | {-1: "a@b.c_d@e.f x..y@z.q@r.s 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111-1111 1111 5 +1 (555) 0123456. +12 a@b @c.d 1234.1.1.1"}
    for i, text in texts.items():
        spans = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if fits(k, m[0])]
        assert pii.entities(text) == spans
        if i >= 0:
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[i].spans.startswith(joined)


def test_fm_index():
    draw = np.random.default_rng(1)
    for top, n in ((1, 30), (3, 400), (50, 3000)):
        symbols = np.append(draw.integers(0, top + 1, n), 0)
        symbols[n // 3 : n // 2] = symbols[: n // 2 - n // 3]  # a repeat
        index = fm_index.FmIndex(symbols, top)
        for size in (1, 2, 5, 10):
            at = draw.integers(0, n - size, 40)
            patterns = np.array([symbols[a : a + size] for a in at])
            patterns = patterns[(patterns > 0).all(1)]
            if not len(patterns):
                continue
            low, high = index.search(patterns)
            for pattern, a, b in zip(patterns, low, high, strict=True):
                places = [i for i in range(n - size + 1) if (symbols[i : i + size] == pattern).all()]
                assert sorted(index.locate(np.arange(a, b))) == places


def test_simhash(spark, small, documents):
    got = by_id(QUERIES["op5_simhash"](spark, small))
    ids = sorted(documents, reverse=True)
    for place, i in enumerate(ids):
        text, after = documents[i], documents[ids[(place + 1) % len(ids)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        other = int(got[ids[(place + 1) % len(ids)]].fingerprint, 16)
        assert got[i].near_next == 1 - (int(got[i].fingerprint, 16) ^ other).bit_count() / 64
        near = sum((int(got[i].fingerprint, 16) ^ int(r.fingerprint, 16)).bit_count() <= 3 for r in got.values())
        assert got[i].n_within == (near if i % 100 == 0 else None)
    rows = list(got.values())
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.15


def test_simhash_blocks_find_every_neighbour(spark):
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(30)]
    prints = base + [b ^ sum(1 << k for k in draw.sample(range(64), draw.randrange(1, 6))) for b in base for _ in range(8)]
    rows = [((p ^ (1 << 63)) - (1 << 63),) for p in prints]
    frame = spark.createDataFrame(rows, "fingerprint long")
    found = simhash.within_radius(frame.limit(30), frame, 3, 6).count()
    assert found == sum(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a in set(base) for b in set(prints))


def test_license_scan(spark, small, documents):
    got = by_id(QUERIES["op8_license_scan"](spark, small))
    for i, text in documents.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        row = got[i]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))


def test_license_suppression(spark):
    assert len(license_rules.all_rules()) > 300
    texts = ["Licensed under the Apache License, Version 2.0", "cc by nc sa 4.0", "see https://creativecommons.org/licenses/by-nd/2.5/", "GNU Lesser General Public License v2.1 and MIT license"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in license_scan.scan(frame).orderBy("doc_id").collect()] == [
        "apache-2.0",
        "cc-by,cc-by-nc-sa-4.0",
        "cc-by-nd-2.5",
        "gpl,lgpl-2.1,mit",
    ]


def test_bpe_equals_the_tiktoken_library(spark, small, documents):
    import public_tokenizers
    import tiktoken

    vocabulary = byte_vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.tokens, special_tokens={})
    odd = ["", "  a  b\n\n c\t", "it's  WE'LL 12 345 ½² ١٢", "　x y ​z\x1c\x85w", "\U0001f600\U0001f1e9\U0001f1ea é", "x" * 3000, "<|endoftext|>", "ab" * 500 + "!?" * 300, "᠎﻿\x00"]
    texts = list(documents.values())[:60] + odd
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(bpe.round_trip(frame, vocabulary))
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text)
        assert got[i].n_tokens == len(ids), repr(text[:50])
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_one_long_piece(spark):
    """Pieces of more than FOLD_BYTES are merged with a heap; one of a million letters takes seconds."""
    import public_tokenizers
    import tiktoken

    vocabulary = byte_vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.tokens, special_tokens={})
    draw = random.Random(5)
    texts = ["".join(draw.choices("etaoinshé", k=n)) for n in (500, 513, 20_000)] + ["aé" * 4000 + " b " + "z" * 700 + " end"]
    frame = spark.createDataFrame([*enumerate(texts), (9, "x" * 1_000_000)], "doc_id long, text string")
    got = by_id(bpe.round_trip(frame, vocabulary))
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert got[9].decoded_sha256 == hashlib.sha256(b"x" * 1_000_000).hexdigest()


def test_bpe_merges_each_word_of_a_batch_once(spark, monkeypatch):
    """Words outside the dictionary are not folded at every occurrence, and come out as by merging them alone."""
    vocabulary = byte_vocabulary()
    words = pa.table({"piece": ["known"], "ids": pa.array([[1, 2, 3]], pa.list_(pa.int32()))})
    merges = bpe.Merges(vocabulary, words)
    draw = random.Random(8)
    pieces = sorted({"".join(draw.choices("etaoinshréж \U0001f600", k=draw.choice((1, 2, 3, 9, 30, 200, 700)))) for _ in range(400)})
    assert merges.fold(pa.array(pieces)).to_pylist() == [bpe._merged(p.encode(), vocabulary.tokens) for p in pieces]
    assert merges.fold(pa.array([], pa.string())).to_pylist() == []
    monkeypatch.setattr(bpe, "PLACED", 7)
    folded, fold = [], merges.fold
    merges.fold = lambda given: folded.extend(given.to_pylist()) or fold(given)
    docs = [draw.choices([*pieces[:20], "known"], k=draw.randrange(12)) for _ in range(300)] + [[], pieces[:1] * 40]
    found = [(ids.to_pylist(), bounds) for _, _, ids, bounds in merges.documents(pa.array([["before"], *docs], pa.list_(pa.string())).slice(1))]
    got = [ids[a:b] for ids, bounds in found for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [[i for p in doc for i in ([1, 2, 3] if p == "known" else bpe._merged(p.encode(), vocabulary.tokens))] for doc in docs]
    assert sorted(folded) == pieces[:20]
    plan = bpe.round_trip(spark.createDataFrame([(1, "a text")], "doc_id long, text string"), vocabulary)
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_slots_hold_every_number_apart():
    draw = random.Random(6)
    for size in (0, 1, 2, 3000):
        numbers = {draw.randrange(-(1 << 63), 1 << 63) for _ in range(size)}
        slots = bpe.Slots(numbers)
        assert set(slots.of) == numbers and len(set(slots.of.values())) == len(numbers)
        assert all(0 <= slot < slots.size for slot in slots.of.values())


def auc(rows, labels):
    scored = sorted((r.score, labels[i]) for i, r in rows.items() if r.held_out and i in labels)
    good = [k for k, (_, y) in enumerate(scored) if y]
    bad = len(scored) - len(good)
    return (sum(good) - len(good) * (len(good) - 1) / 2) / (len(good) * bad)


@pytest.mark.parametrize("query, label, least", [("op6_toxicity", "toxic", 0.85), ("op10_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    folder = "/root/testdata/sf0.01"
    rows = by_id(QUERIES[query](spark, folder))
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if label == "toxic" else 0.3)) for r in rows.values())
    assert auc(rows, labels) >= least


def test_pipeline(spark, small, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, set(documents)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != "byte-level BPE":
            assert docs.columns == columns
        docs = docs.cache()
        now = {r.doc_id for r in docs.collect()}
        assert now <= kept and len(now) > len(kept) // 2, name
        kept = now
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == kept
