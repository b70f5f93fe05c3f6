"""Periodic runs against a search that compares every word with every distance."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sparklog.llm import periodic_runs
from sparklog.llm.queries import QUERIES


def brute_runs(words):
    """(start, length, period) of all runs, one distance after the other."""
    number: dict = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(x) // 3 + 1):
        equal = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]]))
        for start, end in zip(np.flatnonzero(equal == 1).tolist(), np.flatnonzero(equal == -1).tolist(), strict=True):
            if end + q - start >= max(24, 3 * q):
                found.setdefault((start, end + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *shown, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def found_by_document(documents):
    seq = periodic_runs.Sequence([np.array(d, np.int64) for d in documents])
    found = periodic_runs.found_runs(seq)
    own: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for at, (start, end, period) in zip(seq.document(found[:, 0]).tolist(), found.tolist(), strict=True):
        own[at].append((start - int(seq.first[at]), end - start, period))
    return own


def sequences():
    draw = random.Random(5)
    documents = []
    for _ in range(250):
        n, letters = draw.randrange(400), draw.choice([1, 2, 3, 50, 10**6])
        words = [draw.randrange(letters) for _ in range(n)]
        for _ in range(draw.randrange(4)):
            if n > 30:
                a = draw.randrange(n)
                p = 1 + draw.randrange(max((n - a) // 3, 1))
                for i in range(a, min(n, a + draw.randrange(24, 200))):
                    words[i] = words[a + (i - a) % p]
        documents.append(words)
    fibonacci = ["1", "10"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    documents.append([int(c) for c in fibonacci[-1]])
    edges = [[1] * 23, [1] * 24, [*range(8)] * 3, [*range(9)] * 3, ([*range(9)] * 3)[:-1], [*range(15)] * 3, [*range(16)] * 3, [*range(17)] * 3]
    return [*documents, [1] * 1000, [1, 2] * 700, [], ([1] * 10 + [2]) * 60, *edges]


@pytest.mark.parametrize("longest", [8, 16, 4096])
def test_runs_of_random_and_edge_sequences(longest, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LONGEST_BLOCK", longest)
    documents = sequences()
    wanted = [brute_runs(d) for d in documents]
    assert sum(map(len, wanted)) > 150
    assert found_by_document(documents) == wanted


def test_transform_is_exact():
    draw = np.random.default_rng(1)
    for size in (16, 256, 8192):
        rows = draw.integers(0, periodic_runs.PRIME, (3, size))
        assert (periodic_runs.restored(periodic_runs.transformed(rows)) == rows).all()
    x, y = draw.integers(0, periodic_runs.PRIME, (2, 64))
    negative = periodic_runs._roots(64)[2]
    product = periodic_runs.restored(periodic_runs.reduced(periodic_runs.transformed(x[None])[:, negative] * periodic_runs.transformed(y[None])))[0]
    wanted = [sum(int(x[i]) * int(y[(i + t) % 64]) for i in range(64)) % periodic_runs.PRIME for t in range(64)]
    assert product.tolist() == wanted


def test_long_runs_take_no_square():
    """Half a million equal words, and a thousand words over and over."""
    assert found_by_document([[7] * 500_000]) == [[(0, 500_000, 1)]]
    assert found_by_document([list(range(1000)) * 300]) == [[(0, 300_000, 1000)]]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, f"/root/testdata/{folder}").collect()}
    rows = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: brute_row(r.doc_id, r.text) for r in rows}
    assert sum(r[1] > 0 for r in got.values()) > 20


def test_awkward_rows(spark, awkward, nothing):
    def answer(docs):
        return sorted(map(tuple, periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(docs))).collect()), key=str)

    assert answer(awkward) == sorted((brute_row(r.doc_id, r.text) for r in awkward.collect()), key=str)
    assert answer(nothing) == []


def test_collapsed_text(spark):
    rows = [(1, "start " + "tick tock\n" * 30 + "end"), (2, "no run  here"), (3, None), (2, "no run  here")]
    got = periodic_runs.collapsed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "start tick tock end"), (2, "no run here"), (2, "no run here"), (3, "")]
