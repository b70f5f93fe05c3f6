"""Token counts by a two-tier lookup on the map side: no pre-token is ever shuffled.

A byte-level tokenizer splits a text into pre-tokens and merges within each of them, so the number
of tokens of a text is the sum over its pre-tokens. The first tier is a compact table of the token
counts of frequent pre-tokens, at most TABLE_ROWS of them, which is broadcast. What it does not
hold is encoded by the tokenizer library in the task, behind a cache of its Python worker.

Which pre-tokens are frequent is found over all documents: every task keeps a Misra-Gries summary
of at most TABLE_ROWS counters, and summaries, one row for each task, are merged in a tree. A pre-token
with more than 1 / TABLE_ROWS of all occurrences is always in the table. The table only saves time; counts are
exact without it.

Texts are split by the pattern of the tokenizer's byte-level step. A character that the library
classes otherwise than the regex module (they may know different versions of Unicode) is found
by asking both once, and texts that hold one are split by the library. Special strings inside
texts are one token each, as the library has it by default.

Null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows and null ids
each give one result row. No row comes out for an empty table.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.byte_level import CHARACTER_OF_BYTE
from sparklog.llm.common import stored, texts

#: Pre-tokens in the broadcast table, and counters of each summary.
TABLE_ROWS = 1 << 15
#: Longer pre-tokens (in characters) are neither summarised nor cached; they are encoded where they stand.
PIECE_CHARS = 64
#: Entries of a Python worker's cache; it is emptied when full.
CACHE_ROWS = 1 << 18
#: Summaries that one task merges.
FAN_IN = 32
#: Pre-tokens that are looked at at once, so that a very long text needs no list of all of its own.
PIECES = 1 << 17

# Fixed value: the pattern by which byte-level tokenizers of this kind split texts.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def checked(spec: dict) -> None:
    """Only tokenizers that count pre-token by pre-token with the pattern above."""
    step = spec.get("pre_tokenizer") or {}
    plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec.get("truncation") or spec["model"]["type"] != "BPE":
        raise ValueError("a byte-level BPE tokenizer without normaliser, prefix space and truncation is needed")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in their neighbourhood are not supported")


class PieceSplitter:
    """Pre-tokens of texts in one Python worker, and the library's merges within one."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        checked(json.loads(spec))
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.agreed: set[str] = set(map(chr, range(128)))
        self.odd: set[str] = set()

    def _kind(self, char: str, split) -> list[bool]:
        """Whether the character goes on a word, a number, signs."""
        return [len(split(before + char)) == 1 for before in "a1!"]

    def _learn(self, text: str) -> bool:
        """Whether all characters of the text are classed alike by library and pattern."""
        for char in set(text) - self.agreed - self.odd:
            same = self._kind(char, self.tokenizer.pre_tokenizer.pre_tokenize_str) == self._kind(char, self.pattern.findall)
            (self.agreed if same else self.odd).add(char)
        return self.odd.isdisjoint(text) if self.odd else True

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without special strings, in lists of bounded length."""
        if not self._learn(text):
            found = (text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        elif len(text) <= PIECES:
            yield self.pattern.findall(text)
            return
        else:
            found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, PIECES)):
            yield some

    def tokens(self, piece: str) -> list:
        """The library's tokens of one pre-token; its splitting of texts has been done."""
        return self.model.tokenize(piece.encode().decode("latin-1").translate(CHARACTER_OF_BYTE))


class PieceCounter(PieceSplitter):
    """Token counts of pre-tokens behind a bounded cache."""

    def __init__(self, spec: str):
        super().__init__(spec)
        added = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.cache: dict[str, int] = {}

    def segments(self, text: str) -> tuple[int, list[str]]:
        """How many special strings the text holds, and what stands between them."""
        if self.special is None or not self.special.search(text):
            return 0, [text]
        parts = self.special.split(text)
        return len(parts) - 1, parts

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(self.tokens(p)) for p in pieces]

    def missed(self, pieces: list[str]) -> int:
        """Tokens of pre-tokens that the table does not hold."""
        cache = self.cache
        new = [p for p in set(pieces) if p not in cache]
        if len(cache) + len(new) > CACHE_ROWS:
            cache.clear()
            new = list(set(pieces))
        fresh = dict(zip(new, self.lengths(new), strict=True)) if new else {}
        total = sum(fresh[p] if p in fresh else cache[p] for p in pieces)
        cache.update((p, n) for p, n in islice(fresh.items(), CACHE_ROWS) if len(p) <= PIECE_CHARS)
        return total


_COUNTERS: dict[int, PieceCounter] = {}


def _counter(spec: str) -> PieceCounter:
    """This Python worker's counter; workers serve many tasks, so the cache outlives one."""
    key = hash(spec)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PieceCounter(spec)
    return _COUNTERS[key]


def pruned(counts: dict[str, int], rows: int) -> dict[str, int]:
    """A Misra-Gries summary: all counters less the one after the first `rows`, those above zero."""
    if len(counts) <= rows:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(values, len(values) - rows - 1)[len(values) - rows - 1])
    return {piece: n - cut for piece, n in counts.items() if n > cut}


SUMMARY = "slot long, pieces array<string>, counts array<long>"


def _summary_row(slot: int, counts: dict[str, int]) -> pa.RecordBatch:
    columns = [pa.array([slot], pa.int64()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["slot", "pieces", "counts"])


def summaries(docs: DataFrame, spec, rows: int) -> DataFrame:
    """(slot, pieces, counts): one summary of pre-tokens for each task, by the number of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in counter.segments(text.as_py())[1]:
                    for pieces in counter.pieces(part):
                        counts.update(pieces)
                        if len(counts) > 8 * rows:
                            counts = Counter(pruned(counts, rows))
        short = {p: n for p, n in counts.items() if len(p) <= PIECE_CHARS}
        if short:
            yield _summary_row(TaskContext.get().partitionId(), pruned(short, rows))

    return docs.select("text").mapInArrow(run, SUMMARY)


def merged(parts: DataFrame, rows: int) -> DataFrame:
    """Summaries of FAN_IN neighbouring slots as one each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        counts: Counter[str] = Counter()
        for pieces, own in zip(table.column("pieces").to_pylist(), table.column("counts").to_pylist(), strict=True):
            counts.update(dict(zip(pieces, own, strict=True)))
        return pa.Table.from_batches([_summary_row(key[0].as_py(), pruned(counts, rows))])

    return parts.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("long")).groupBy("slot").applyInArrow(run, SUMMARY)


def frequent_pieces(docs: DataFrame, spec, rows: int = TABLE_ROWS) -> list[str]:
    """The pre-tokens of the merged summary of all documents: at most `rows`, so they may go to the driver."""
    parts = stored(summaries(docs, spec, rows), "pieces")
    last = parts.agg(F.max("slot")).first()[0]
    while last:
        parts, last = merged(parts, rows), last // FAN_IN
    found = parts.collect()  # one row
    return found[0]["pieces"] if found else []


def packed_table(pieces: list[str], lengths: list[int]) -> tuple[bytes, bytes, bytes]:
    """The table as three byte strings: the pieces on end, their ends, their token counts."""
    raw = [p.encode() for p in pieces]
    return b"".join(raw), np.cumsum([len(r) for r in raw], dtype=np.int64).tobytes(), np.array(lengths, np.int32).tobytes()


def unpacked_table(packed: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    blob, ends, lengths = packed[0], np.frombuffer(packed[1], np.int64).tolist(), np.frombuffer(packed[2], np.int32).tolist()
    return {blob[a:b].decode(): n for a, b, n in zip([0, *ends], ends, lengths, strict=False)}


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 1024, rows: int = TABLE_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of `docs`.

    `tokenizer_json` is the text of a byte-level tokenizer's file, which the driver has read;
    over_limit says whether a text has more than `limit` tokens.
    """
    checked(json.loads(tokenizer_json))
    context = docs.sparkSession.sparkContext
    spec = context.broadcast(tokenizer_json)
    frequent = frequent_pieces(texts(docs), spec, rows)
    table = context.broadcast(packed_table(frequent, PieceCounter(tokenizer_json).lengths(frequent) if frequent else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        known = unpacked_table(table.value)
        for batch in batches:
            sizes, totals = [], []
            for value in batch.column(1):
                text = value.as_py()
                total, parts = counter.segments(text)
                for part in parts:
                    for pieces in counter.pieces(part):
                        found = list(map(known.get, pieces))
                        if None in found:
                            total += counter.missed([p for p, n in zip(pieces, found, strict=True) if n is None])
                        total += sum(filter(None, found))
                sizes.append(len(value.as_buffer()))
                totals.append(total)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    counted = texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
