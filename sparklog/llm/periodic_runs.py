"""Stretches of words that repeat with a period, found by block convolution.

A run is a stretch of words with smallest period q and at least max(LEAST, TIMES * q) words that no
neighbouring word extends. Periods are looked for at dyadic scales: the first has the distances 1 to
2 * BASE - 1, every other one the distances P to 2P - 1, P = 2 * BASE, 4 * BASE, ... A run with a period
of that scale holds a block of words at a multiple of P whose copy stands one period on, within the run.
So at each scale the blocks at multiples of P are compared with the windows that follow. For block x and
window y the sum of (x[i] - y[i + d])^2 is wanted for all distances d at once: the squares come from
running sums, the products from a number-theoretic transform, exactly, modulo PRIME. A zero is a
seed (words are residues there, so a zero is necessary for an occurrence, not yet proof).

Every seed is extended to both sides word by word, so that the result is exact. Seeds inside a known
run whose period divides their distance are that run again and are left out, as are seeds that continue
another one's block. Of stretches with the same ends the smallest period counts.

The words of many documents stand in one array with a different number between any two of them, so a
task transforms the blocks of all its documents together, in slices of bounded size. Longer blocks than
LONGEST_BLOCK are cut to that many words; their windows are then taken one by one.

Words are `[^\\x20\\x09-\\x0D]+`, compared byte by byte. Null and empty texts have no words and no runs.
Rows are independent: repeated rows and null ids each give one result row, and an empty table none.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import texts
from sparklog.llm.words import mix, slices

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 24, 3
#: Words of the blocks of the first scale; LEAST >= 2 * BASE - 1 + BASE, so that each run holds a block and its copy.
BASE = 8
#: Words of the longest block; its transform has twice as many places, and PRIME - 1 is a multiple of that.
LONGEST_BLOCK = 1 << 12
#: A prime whose multiplicative group has 2^16 elements, generated by ROOT.
PRIME, ROOT = 65_537, 3
#: Numbers transformed at once: they stay in the processor's cache.
CHUNK = 1 << 15


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers of less than 2^47 modulo 2^16 + 1, as numbers between -2^16 and 2^17; 2^16 is -1 there."""
    x = (x & 0xFFFF) - (x >> 16)
    return (x & 0xFFFF) - (x >> 16)


@lru_cache(maxsize=32)
def _roots(size: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, int]:
    """Factors of each halving step and of its inverse, where index -k stands, and 1 / size."""
    forward, backward = [], []
    step = size
    while step > 1:
        root = pow(ROOT, (PRIME - 1) // step, PRIME)
        forward.append(np.array([pow(root, k, PRIME) for k in range(step // 2)], np.int64))
        back = pow(root, -1, PRIME)
        backward.append(np.array([pow(back, k, PRIME) for k in range(step // 2)], np.int64))
        step //= 2
    bits = size.bit_length() - 1
    order = np.zeros(size, np.int64)
    for b in range(bits):
        order |= ((np.arange(size) >> b) & 1) << (bits - 1 - b)
    negative = order[(-order) % size]  # order is its own inverse
    return forward, backward, negative, pow(size, -1, PRIME)


def transformed(rows: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of each row, in bit-reversed order."""
    k, size = rows.shape
    a = rows
    for factors in _roots(size)[0]:
        half = len(factors)
        pairs = a.reshape(k, -1, 2, half)
        out = np.empty_like(pairs)
        np.add(pairs[:, :, 0], pairs[:, :, 1], out=out[:, :, 0])
        out[:, :, 1] = reduced((pairs[:, :, 0] - pairs[:, :, 1]) * factors)
        a = out.reshape(k, size)
    return reduced(a)


def restored(rows: np.ndarray) -> np.ndarray:
    """The inverse of `transformed`, as numbers from 0 to PRIME - 1."""
    k, size = rows.shape
    _, factors_of, _, share = _roots(size)
    a = rows
    for factors in reversed(factors_of):
        half = len(factors)
        pairs = a.reshape(k, -1, 2, half)
        turned = reduced(pairs[:, :, 1] * factors)
        out = np.empty_like(pairs)
        np.add(pairs[:, :, 0], turned, out=out[:, :, 0])
        np.subtract(pairs[:, :, 0], turned, out=out[:, :, 1])
        a = out.reshape(k, size)
    return reduced(reduced(a) * share) % PRIME


class Sequence:
    """Words of several documents in one array: `ids`, with a number of its own before, between and after them."""

    def __init__(self, documents: list[np.ndarray]):
        sizes = np.array([len(d) for d in documents], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes  # place of each document's first word
        self.after = self.first + sizes
        total = int(self.after[-1]) + 1 if len(sizes) else 1
        self.ids = np.empty(total, np.int64)
        self.ids[0] = -1
        for at, words in zip(self.first, documents, strict=True):
            self.ids[at : at + len(words)] = words
        self.ids[self.after] = -2 - np.arange(len(sizes))
        self.values = (mix(self.ids.astype(np.uint64)) % np.uint64(PRIME)).astype(np.int64)
        self.squares = np.concatenate([[0], np.cumsum(self.values * self.values % PRIME)])

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.after, places, "right")


def block_starts(seq: Sequence, scale: int, block: int) -> np.ndarray:
    """Multiples of the scale from which a block and a copy at that distance fit into a document long enough."""
    starts = []
    least = max(LEAST, TIMES * scale if scale > BASE else LEAST)
    for first, after in zip(seq.first[seq.after - seq.first >= least], seq.after[seq.after - seq.first >= least], strict=True):
        low = -(-first // scale) * scale
        nearest = 1 if scale == BASE else scale
        starts.append(np.arange(low, after - block - nearest + 1, scale, dtype=np.int64))
    return np.concatenate(starts) if starts else np.zeros(0, np.int64)


def _gathered(seq: Sequence, starts: np.ndarray, block: int) -> np.ndarray:
    """The blocks at `starts` padded with zeros to twice their length; zeros stand beyond the last word too."""
    rows = np.zeros((len(starts), 2 * block), np.int64)
    places = starts[:, None] + np.arange(block)
    rows[:, :block] = np.where(places < len(seq.values), seq.values[np.minimum(places, len(seq.values) - 1)], 0)
    return rows


def occurrences(seq: Sequence, starts: np.ndarray, block: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) with distances from `offset` to `offset` + block - 1 at which a block occurs again.

    The window is two blocks long. The block's products with both halves are transforms of twice its
    length; the second half's is moved by one block, which in the transform is a change of sign of odd places.
    """
    negative = _roots(2 * block)[2]
    found = [], []
    step = max(CHUNK // (2 * block), 1)
    for low in range(0, len(starts), step):
        own = starts[low : low + step]
        # blocks that follow one another share their transforms
        needed, inverse = np.unique(np.concatenate([own, own + offset, own + offset + block]), return_inverse=True)
        spectra = transformed(_gathered(seq, needed, block))
        x, near, far = (spectra[inverse[k * len(own) : (k + 1) * len(own)]] for k in range(3))
        window = near + far
        window[:, block:] = near[:, block:] - far[:, block:]
        products = restored(reduced(x[:, negative] * window))[:, :block]
        top = len(seq.squares) - 1
        place = own[:, None] + offset + np.arange(block)
        inside = place + block <= top
        squares = seq.squares[np.minimum(place + block, top)] - seq.squares[np.minimum(place, top)]
        squares += (seq.squares[own + block] - seq.squares[own])[:, None]
        row, at = np.nonzero((squares - 2 * products) % PRIME == 0)
        keep = inside[row, at]
        found[0].append(own[row[keep]])
        found[1].append(offset + at[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else (none, none)


def _unchained(start: np.ndarray, distance: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Without seeds that follow another one of their distance by exactly one block: the extension of that one holds them."""
    by = np.lexsort((start, distance))
    start, distance = start[by], distance[by]
    chained = np.zeros(len(start), np.bool_)
    chained[1:] = (distance[1:] == distance[:-1]) & (start[1:] - start[:-1] == block)
    return start[~chained], distance[~chained]


def _reach(seq: Sequence, start: np.ndarray, distance: np.ndarray, side: int) -> np.ndarray:
    """How many words from `start` on (side 1) or before it (side -1) equal the word `distance` on."""
    length = np.zeros(len(start), np.int64)
    active, width = np.arange(len(start)), 16
    top = len(seq.ids) - 1
    while len(active):
        going = []
        for low in range(0, len(active), max((1 << 20) // width, 1)):
            some = active[low : low + max((1 << 20) // width, 1)]
            steps = length[some][:, None] + np.arange(width)
            place = start[some][:, None] + (steps if side > 0 else -1 - steps)
            # numbers between documents differ from all others, so no comparison goes on beyond one
            other = seq.ids[np.clip(place + distance[some][:, None], 0, top)]
            differs = (seq.ids[np.clip(place, 0, top)] != other) | (place < 0) | (place + distance[some][:, None] > top)
            ends = differs.any(axis=1)
            length[some] += np.where(ends, differs.argmax(axis=1), width)
            going.append(some[~ends])
        active, width = np.concatenate(going), min(width * 4, 1 << 14)
    return length


def found_runs(seq: Sequence) -> np.ndarray:
    """All runs, as rows (start, end, period) of places in the sequence, by start and period."""
    runs = np.zeros((0, 3), np.int64)
    longest = int((seq.after - seq.first).max()) if len(seq.first) else 0
    scale = BASE
    while scale == BASE or TIMES * scale <= longest:
        block = min(scale, LONGEST_BLOCK)
        starts = block_starts(seq, scale, block)
        windows = [0, BASE] if scale == BASE else range(scale, 2 * scale, block)
        seeds = [occurrences(seq, starts, block, offset) for offset in windows]
        start, distance = (np.concatenate(part) for part in zip(*seeds, strict=True))
        start, distance = start[distance > 0], distance[distance > 0]
        if len(runs) and len(start):
            # the longest known run at the seed's place
            covering = np.full(len(seq.ids), -1, np.int64)
            for k in np.argsort(runs[:, 1] - runs[:, 0], kind="stable"):
                covering[runs[k, 0] : runs[k, 1]] = k
            over = covering[start]
            within = (over >= 0) & (runs[over, 1] >= start + distance + block) & (distance % runs[over, 2] == 0)
            start, distance = start[~within], distance[~within]
        if len(start):
            if scale == block:
                start, distance = _unchained(start, distance, block)
            low = start - _reach(seq, start, distance, -1)
            end = start + _reach(seq, start, distance, 1) + distance
            long = (end - low >= np.maximum(LEAST, TIMES * distance)) & (end - distance - start >= 0)
            new = np.stack([low[long], end[long], distance[long]], axis=1)
            runs = np.concatenate([runs, new])
            runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
            other = np.ones(len(runs), np.bool_)
            other[1:] = (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)
            runs = runs[other]  # of equal ends the smallest period
        scale *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _without(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start and period, and its words
    without those that a run repeats, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            column, ids = batch.column(1).cast(pa.large_binary()), batch.column(0)
            for low, high, data, bounds in slices(column):
                numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
                documents = [data[bounds[k] : bounds[k + 1]].tobytes().split() for k in range(high - low)]
                seq = Sequence([np.array([numbers[w] for w in words], np.int64) for words in documents])
                own: list[list[tuple[int, int, int]]] = [[] for _ in documents]
                found = found_runs(seq)
                for at, (start, end, period) in zip(seq.document(found[:, 0]).tolist(), found.tolist(), strict=True):
                    own[at].append((start - int(seq.first[at]), end - start, period))
                collapsed = [b" ".join(_without(words, runs) if runs else words) for words, runs in zip(documents, own, strict=True)]
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in own]
                columns = [ids.slice(low, high - low), pa.array([len(w) for w in documents], pa.int64()), pa.array(listed, kind)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return texts(docs).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every text without the words that its runs repeat."""
    return periodic_runs(docs).select("doc_id", F.col("collapsed").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of `periodic_runs`.

    The run shown has the greatest length for its period, compared exactly by products; of equal ones it is
    the first by start, then period.
    """

    def better(best: Column, other: Column) -> Column:
        return other["length"] * best["period"] > best["length"] * other["period"]

    empty = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", empty, lambda b, r: F.when(b.isNull() | better(b, r), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listing = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * b.length div b.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli, "runs_sha256", "collapsed_sha256")


#: Fixed value: what stands between words.
SPACES = r"[\x20\x09-\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document by a hash of its id, the last words go round with a period.

    With h = crc32 of the id in decimal digits, h % 10 = 0, n words, g = floor(h / 10), a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)), each word i >= a becomes word a + (i - a) % p. Rows without an id or
    words stay.
    """
    rows = texts(docs)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.filter(F.split("text", SPACES), lambda w: w != ""))
    steps = rows.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), words.alias("words"))
    steps = steps.select("*", F.when(F.size("words") > 0, F.size("words")).alias("n"))
    steps = steps.select("*", (F.col("g") % F.col("n")).cast("int").alias("a"))
    left = F.col("n") - F.col("a")
    steps = steps.select("*", left.alias("left"), (F.floor(left / (3 + F.col("g") % 8)) + 1).cast("int").alias("p"))
    round_ = F.slice("words", F.col("a") + 1, F.least("p", "left"))
    repeated = F.flatten(F.array_repeat(round_, F.ceil(F.col("left") / F.col("p")).cast("int")))
    changed = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), F.col("left")))
    return steps.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))
