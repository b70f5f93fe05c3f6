"""Benchmark decontamination with one FM-index for each shard of the documents.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Ten consecutive
words of a benchmark item are a window; an item of fewer words is one window. A document word
inside any occurrence of a window is hit, and overlapping occurrences are merged into spans.

A shard is some consecutive documents of one task, SHARD_WORDS words in all or one longer
document. Its words become numbers of the benchmark's vocabulary. A word that the benchmark
does not have ends a stretch, as the end of a text does, since no window reaches across it. The
windows are searched backwards through wavelet ranks and located by sampled suffix positions.

The benchmark is read in blocks of BLOCK_WORDS words, with one pass over the documents for each,
so what a task receives does not grow with the benchmark.

Null texts have no words. Rows are independent of each other, so repeated rows and null ids keep
one result for each row. Item ids are compared as text; items with a null id count as "null".
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import packed, stored, unpacked
from sparklog.llm.fm_index import FmIndex
from sparklog.llm.words import NOT_WORDS, Words, slices

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 20


class Phrases:
    """The distinct windows of a block of items, as word numbers, and the items each stands in."""

    def __init__(self, items: list[tuple[str, str]]):
        by_length: dict[int, dict[bytes, set[int]]] = {}
        ids = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(ids)}
        column = pa.array([text for _, text in items], pa.string())
        parts, names = [], []
        for low, high, data, bounds in slices(column):
            words = Words(data, bounds, NOT_WORDS)
            for k in range(low, high):
                parts.append(words.hash[words.first[k - low] : words.first[k - low + 1]])
                names.append(number[items[k][0]])
        self.vocabulary = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        for hashes, name in zip(parts, names, strict=True):
            symbols = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int64)
            size = min(len(symbols), WINDOW)
            for at in range(len(symbols) - size + 1) if size else ():
                by_length.setdefault(size, {}).setdefault(symbols[at : at + size].tobytes(), set()).add(name)
        self.items = ids
        self.groups = []
        for size, windows in sorted(by_length.items()):
            symbols = np.frombuffer(b"".join(windows), np.int64).reshape(len(windows), size)
            counts = np.array([len(names) for names in windows.values()])
            owners = np.concatenate([np.array(sorted(names)) for names in windows.values()])
            self.groups.append((size, symbols, np.cumsum(counts) - counts, counts, owners))


def _expand(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... count[i] of them, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - count), count)


class Shard:
    """Some documents' words, and the occurrences of phrases in them."""

    def __init__(self, phrases: Phrases, hashes: np.ndarray, first: np.ndarray):
        self.first, total = first, int(first[-1])
        place = np.searchsorted(phrases.vocabulary, hashes)
        known = place < len(phrases.vocabulary)
        known[known] = phrases.vocabulary[place[known]] == hashes[known]
        begins = np.zeros(total, np.bool_)
        begins[first[:-1][first[:-1] < total]] = True
        # a stretch is a run of known words in one text; each one ends in a separator
        opens = known.copy()
        opens[1:] &= ~known[:-1] | begins[1:]
        at = np.flatnonzero(known)
        stretch = np.cumsum(opens)[at]
        symbols = np.zeros(len(at) + (int(stretch[-1]) if len(at) else 0), np.int64)
        slots = np.arange(len(at)) + stretch - 1
        symbols[slots] = place[at] + 1
        word_at = np.full(len(symbols), -1, np.int64)
        word_at[slots] = at
        starts, lengths, owners, texts_ = [], [], [], []
        if len(at):
            index = FmIndex(symbols, len(phrases.vocabulary))
            for size, windows, owner_low, owner_count, owner in phrases.groups:
                low, high = index.search(windows)
                found = np.maximum(high - low, 0)
                words = word_at[index.locate(_expand(low, found))]
                window = np.repeat(np.arange(len(windows)), found)
                starts.append(words)
                lengths.append(np.full(len(words), size))
                document = np.searchsorted(first, words, "right") - 1
                pairs = np.unique(document * len(windows) + window)
                window = pairs % len(windows)
                owners.append(owner[_expand(owner_low[window], owner_count[window])])
                texts_.append(np.repeat(pairs // len(windows), owner_count[window]))
        change = np.zeros(total + 1, np.int64)
        if starts:
            start, length = np.concatenate(starts), np.concatenate(lengths)
            change += np.bincount(start, minlength=total + 1) - np.bincount(start + length, minlength=total + 1)
        self.hit = np.cumsum(change[:-1]) > 0
        owners_ = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        documents = np.concatenate(texts_) if texts_ else np.zeros(0, np.int64)
        self.pairs = np.unique(documents * max(len(phrases.items), 1) + owners_)


def _shards(batch: pa.RecordBatch, phrases: Phrases, with_text: bool) -> Iterator[pa.RecordBatch]:
    ids, text, old_spans, old_items, *carried = batch.columns
    rows = max(len(phrases.items), 1)
    for low, high, data, bounds in slices(text):
        words = Words(data, bounds, NOT_WORDS)
        from_ = 0
        while from_ < high - low:
            to = max(from_ + 1, int(np.searchsorted(words.first, words.first[from_] + SHARD_WORDS, "right")) - 1)
            base = words.first[from_]
            local = words.first[from_ : to + 1] - base
            shard = Shard(phrases, words.hash[base : base + local[-1]], local)
            own = np.searchsorted(shard.pairs, np.arange(to - from_ + 1) * rows)
            spans, items, cut = [], [], []
            for k, earlier, known in zip(
                range(to - from_), old_spans[low + from_ : low + to].to_pylist(), old_items[low + from_ : low + to].to_pylist(), strict=True
            ):
                hit = shard.hit[local[k] : local[k + 1]]
                for begin, end in earlier:
                    hit[begin:end] = True
                edges = np.flatnonzero(np.diff(hit.view(np.int8), prepend=0, append=0))
                spans.append(edges.reshape(-1, 2).tolist())
                items.append(list(dict.fromkeys([*known, *(phrases.items[i] for i in shard.pairs[own[k] : own[k + 1]] % rows)])))
                if with_text:
                    cut.append(_cut(words, int(base + local[k]), spans[-1], data, int(bounds[from_ + k]), int(bounds[from_ + k + 1])))
            columns = [ids.slice(low + from_, to - from_), pa.array(np.diff(local), pa.int64())]
            columns += [pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "spans", "items"]
            if with_text:
                columns += [text.slice(low + from_, to - from_), pa.array(cut, pa.binary()).cast(pa.string())]
                columns += [column.slice(low + from_, to - from_) for column in carried]
                names += ["text", "cut", "_row"]
            yield pa.RecordBatch.from_arrays(columns, names)
            from_ = to


def _cut(words: Words, base: int, spans: list[list[int]], data: np.ndarray, begin: int, end: int) -> bytes:
    """The bytes begin:end without those from the first to the last word of each span."""
    kept, at = [], begin
    for first, after in spans:
        kept.append(data[at : words.start[base + first]].tobytes())
        at = words.end[base + after - 1]
    return b"".join([*kept, data[at:end].tobytes()])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items, in blocks that the driver and each task hold one at a time."""
    block, size = [], 0
    chosen = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string"))
    for item, text in chosen.toLocalIterator():
        block.append((item, text or ""))
        size += len(text or "") // 2 + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items) of each document: merged spans of hit words, [first, after the last].

    With `with_text` also the text, `cut`, the text without its spans, and `_row`, all columns. A benchmark of
    more than one block takes a pass over the documents for each, written to the shared folder between.
    """
    empty = F.array().cast("array<array<long>>").alias("spans"), F.array().cast("array<string>").alias("items")
    state = packed(docs).select("doc_id", "text", *empty, "_row")
    blocks = _blocks(benchmark)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        state = _pass(state, block, with_text or following is not None)
        if following is None:
            return state
        state, block = stored(state, "spans").select("doc_id", "text", "spans", "items", "_row"), following


def _pass(state: DataFrame, block: list[tuple[str, str]], with_text: bool) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(block)
    if not with_text:
        state = state.drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value)
        for batch in batches:
            yield from _shards(batch, phrases, with_text)

    schema = state.select("doc_id").schema.add("n_words", "long").add(state.schema["spans"]).add(state.schema["items"])
    if with_text:
        schema = schema.add("text", "string").add("cut", "string").add(state.schema["_row"])
    return state.mapInArrow(run, schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    return unpacked(search(docs, benchmark, with_text=True).where(F.size("spans") == 0), docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and digests of what `search` finds, one row for each document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span[1] - span[0])
    return search(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, ws[pos + 1 : pos + 10] AS body
  FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS pos FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, pos, ws[pos + 1 : pos + size] AS body
  FROM (SELECT doc_id, ws, size, unnest(range(len(ws) - size + 1)) AS pos FROM words, sizes WHERE len(ws) >= size)),
met AS (SELECT p.doc_id, p.pos, p.size, w.item_id FROM places p JOIN windows w ON p.size = w.size AND p.body = w.body),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM met) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.joined, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""
