"""Byte-level BPE encoding and decoding of texts, word by word.

A text is split by the tokenizer's pattern. Words are encoded once each, not at every occurrence: in a
Python worker the pieces of a batch are numbered by word, and the tokens of the words put in their places.

Distinct frequent words, DICTIONARY_ROWS at most of WORD_BYTES bytes each, are folded once for all texts
with Spark's higher-order functions: a piece is the array of its bytes' tokens, over which `aggregate`
folds the merges; in each step the leftmost pair of the lowest rank becomes one token. Ranks come from
a literal map from pairs of tokens to the rank of the merged token. A Spark map is read from end to end, so
the literal is an array in which every pair has a slot of its own (`Slots`).

The dictionary only saves time. Other words are merged in the worker by the same slots, all words of a
batch and a length at once (`Merges`). Tokens that no merges lead to are words of the dictionary too. A
piece of more than FOLD_BYTES bytes is merged with a heap. Decoding joins the tokens' bytes.

Null texts are empty and have no tokens. Rows are independent, so repeated rows and null ids
keep one result each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import stored, texts

DICTIONARY_ROWS = 1 << 16
WORD_BYTES = 64
FOLD_BYTES = 512
#: Pairs that are not merged have ranks from here on.
NONE = 1 << 20
#: Bytes of words merged at once, and pieces whose tokens are put in place at once.
CELLS, PLACED = 1 << 20, 1 << 20

# Fixed value: the characters that Unicode counts as white space.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern with \\s and \\S spelt out, which in Java stand for ASCII white space."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


class Slots:
    """A slot of its own for each of some different 64-bit numbers, by hash and displace.

    Numbers are dealt to buckets, and each bucket, the fullest ones first, gets the first displacement
    that takes all its numbers to free slots. Half of the slots stay free.
    """

    SPREAD = 0x9E3779B97F

    def __init__(self, numbers: Iterable[int]):
        numbers = list(numbers)
        self.size = 2 * len(numbers) + 1
        self.buckets = len(numbers) // 4 + 1
        dealt = defaultdict(list)
        for number in numbers:
            dealt[number % self.buckets].append(number)
        self.of: dict[int, int] = {}
        taken, moves = bytearray(self.size), [0] * self.buckets
        for bucket in sorted(dealt, key=lambda b: -len(dealt[b])):
            for move in count():
                places = [(number ^ (move * self.SPREAD)) % self.size for number in dealt[bucket]]
                if len(set(places)) == len(places) and not any(taken[p] for p in places):
                    break
            moves[bucket] = move * self.SPREAD
            for number, place in zip(dealt[bucket], places, strict=True):
                self.of[number], taken[place] = place, 1
        self.shifts = moves
        self.moves = _numbers(moves, "bigint")

    def slot(self, number: Column) -> Column:
        move = F.get(self.moves, F.pmod(number, F.lit(self.buckets).cast("long")).cast("int"))
        return F.pmod(number.bitwiseXOR(move), F.lit(self.size).cast("long")).cast("int")


def merged_by_heap(piece: bytes, tokens: dict[bytes, int]) -> list[int]:
    """The tokens of one piece, by merging the leftmost pair of lowest rank until none is left."""
    whole = tokens.get(piece)
    return [whole] if whole is not None else _merged(piece, tokens)


def _merged(piece: bytes, tokens: dict[bytes, int]) -> list[int]:
    size = len(piece)
    end = list(range(1, size + 1))  # of the token that starts here; 0 where none does any more
    before = list(range(-1, size))
    heap = [(tokens[piece[i : i + 2]], i, i + 2) for i in range(size - 1) if piece[i : i + 2] in tokens]
    heapq.heapify(heap)

    def offer(at: int) -> None:
        if end[at] < size:
            to = end[end[at]]
            rank = tokens.get(piece[at:to])
            if rank is not None:
                heapq.heappush(heap, (rank, at, to))

    while heap:
        _, at, to = heapq.heappop(heap)
        middle = end[at]
        if not middle or middle >= size or end[middle] != to or middle == to:
            continue  # one of the two has been merged since
        end[at], end[middle] = to, 0
        if to < size:
            before[to] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    found, at = [], 0
    while at < size:
        found.append(tokens[piece[at : end[at]]])
        at = end[at]
    return found


class Vocabulary:
    """Ranks of a tokenizer file and the literals made from them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.tokens = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        top = max(self.tokens.values()) + 1
        if top > NONE:
            raise ValueError(f"a vocabulary of {top} ranks; the literal rank map holds {NONE}")
        self.pattern = java_pattern(pattern)
        pairs = self._last_pairs()
        self.slots = Slots(pairs)
        ranks = [1 << 61] * self.slots.size
        for pair, rank in pairs.items():
            ranks[self.slots.of[pair]] = (pair << 20) | rank
        self.by_slot = ranks
        self.ranks = _numbers(ranks, "bigint")
        self.bytes = _numbers([self.tokens[bytes([b])] for b in range(256)], "bigint")

    def rank(self, left: Column, right: Column) -> Column:
        """The rank of a pair; a number of NONE or more if its slot holds another pair or none."""
        pair = F.shiftleft(left, 20).bitwiseOR(right)
        return F.get(self.ranks, self.slots.slot(pair)).bitwiseXOR(F.shiftleft(pair, 20))

    def _last_pairs(self) -> dict[int, int]:
        """The pair whose merge makes each token, as one number, and the token's rank.

        The merges within a stretch of a text are those of the stretch alone, as long as none goes over
        its ends. So a token comes from one pair only, the two tokens left when it is merged without itself.
        """
        pairs, self.unreached = {}, []
        for token, rank in list(self.tokens.items()):
            if len(token) > 1:
                del self.tokens[token]
                parts = _merged(token, self.tokens)
                self.tokens[token] = rank
                if len(parts) == 2:
                    pairs[(parts[0] << 20) | parts[1]] = rank
                else:
                    self.unreached.append(token)
        return pairs

    def unreached_texts(self) -> list[tuple[str, list[int]]]:
        """The tokens that are texts by themselves but not what merging their bytes leads to."""
        found = []
        for token in self.unreached:
            try:
                found.append((token.decode(), [self.tokens[token]]))
            except UnicodeDecodeError:
                continue
        return found


def _numbers(values: Iterable[int], kind: str) -> Column:
    """A literal array, parsed once while the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(piece: Column, vocabulary: Vocabulary) -> Column:
    """The tokens of one piece, by merging pairs of lowest rank until none is left.

    The state holds the tokens, the ranks of their pairs before and after a gap, and the few tokens
    `low`, `low + 1`, ... of the gap whose pairs are still to be ranked: all at first, later those
    around the last merge; `low` is 0 when no pair is left. The rank map stands in the expression once.
    """
    letters = F.split(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), "")
    start = F.transform(letters, lambda c: F.get(vocabulary.bytes, F.ascii(c)))
    none = F.array().cast("array<bigint>")

    def state(ids: Column, left: Column, right: Column, low: Column, count: Column) -> Column:
        return F.struct(ids.alias("ids"), left.alias("left"), right.alias("right"), low.alias("low"), count.alias("count"))

    def merged(ids: Column, ranks: Column, rank: Column, at: Column) -> Column:
        joined = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(rank), F.slice(ids, at + 2, F.size(ids)))
        low = F.greatest(at - 1, F.lit(1))
        count = F.least(at + 1, F.size(ids) - 1) - low + 1
        return state(joined, F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), F.slice(ranks, at + 2, F.size(ids)), low, count)

    def step(s: Column, _: Column) -> Column:
        gap = F.slice(s["ids"], s["low"], s["count"])
        fresh = F.zip_with(F.slice(gap, F.lit(1), s["count"] - 1), F.slice(gap, F.lit(2), s["count"] - 1), vocabulary.rank)

        def lowest(ranks: Column) -> Column:
            done = state(s["ids"], none, none, F.lit(0), F.lit(0))
            return let(
                F.array_min(ranks),
                lambda rank: F.when(rank >= NONE, done).otherwise(let(F.array_position(ranks, rank).cast("int"), lambda at: merged(s["ids"], ranks, rank, at))),
            )

        return F.when(s["low"] == 0, s).otherwise(let(F.concat(s["left"], fresh, s["right"]), lowest))

    def folded(ids: Column) -> Column:
        return F.aggregate(F.slice(ids, 2, F.size(ids)), state(ids, none, none, F.lit(1), F.size(ids)), step, lambda s: s["ids"])

    return let(start, lambda ids: F.when(F.size(ids) > 1, folded(ids)).otherwise(ids)).cast("array<int>")


def pieces(text: Column, vocabulary: Vocabulary) -> Column:
    return F.regexp_extract_all(text, F.lit(vocabulary.pattern), F.lit(0))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, rows: int = DICTIONARY_ROWS) -> DataFrame:
    """(piece, ids): the tokens of at most `rows` most frequent pieces of all documents."""
    each = docs.select(F.explode(pieces(F.col("text"), vocabulary)).alias("piece")).where(F.octet_length("piece") <= WORD_BYTES)
    level = F.floor(F.log2("n") * 8).cast("int")
    counted = stored(each.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("level", level), "pieces")
    least, total = 1 << 30, 0
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # a few hundred levels
        total += row["count"]
        if total > rows:
            break
        least = row["level"]
    return counted.where(F.col("level") >= least).select("piece", fold(F.col("piece"), vocabulary).alias("ids"))


class Merges:
    """The tokens of many pieces at once in a Python worker; `words` (piece, ids) are known before."""

    def __init__(self, vocabulary: Vocabulary, words: pa.Table):
        self.tokens = vocabulary.tokens
        self.bytes = np.array([self.tokens[bytes([b])] for b in range(256)], np.int32)
        self.shifts, self.by_slot = np.array(vocabulary.slots.shifts, np.int64), np.array(vocabulary.by_slot, np.int64)
        by_rank = defaultdict(bytes, {rank: token for token, rank in self.tokens.items()})
        self.texts = pa.array([by_rank[rank] for rank in range(max(by_rank) + 1)], pa.binary())
        self.known = pa.array(words.column("piece").to_pylist(), pa.string())
        self.known_ids = pa.array(words.column("ids").to_pylist(), pa.list_(pa.int32()))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where a pair is not merged."""
        pair = (left.astype(np.int64) << 20) | right
        slot = (pair ^ self.shifts[pair % len(self.shifts)]) % len(self.by_slot)
        return np.minimum(self.by_slot[slot] ^ (pair << 20), NONE).astype(np.int32)

    def _merged(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of `ids`, the bytes of a piece each, and their tokens, by number of tokens.

        In each round every row that is left merges its leftmost pair of lowest rank, so all keep one length.
        """
        rows, ranks = np.arange(len(ids)), self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows) and ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), at]
            more = rank < NONE
            if not more.all():
                yield rows[~more], ids[~more]
                rows, ids, ranks, at, rank = rows[more], ids[more], ranks[more], at[more], rank[more]
            size, width = ids.shape
            ids[np.arange(size), at] = rank
            ids = ids[np.arange(width) != at[:, None] + 1].reshape(size, width - 1)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(size, width - 2)
            for changed, low in ((np.flatnonzero(at > 0), at - 1), (np.flatnonzero(at < width - 2), at)):
                low = low[changed]
                ranks[changed, low] = self.rank(ids[changed, low], ids[changed, low + 1])
        yield rows, ids

    def fold(self, pieces: pa.Array) -> pa.ListArray:
        """The tokens of each piece."""
        pieces = pa.concat_arrays([pieces.cast(pa.large_binary())])  # from offset 0
        _, offsets, data = pieces.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(pieces) + 1] if offsets else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        order = np.argsort(sizes, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            size = int(sizes[own[0]]) if len(own) else 0
            if size > FOLD_BYTES:
                found += [(own[k : k + 1], np.array([merged_by_heap(pieces[int(own[k])].as_py(), self.tokens)], np.int32)) for k in range(len(own))]
                continue
            step = CELLS // max(size, 1)
            for some in (own[low : low + step] for low in range(0, len(own), step)):
                letters = self.bytes[data[offsets[some][:, None] + np.arange(size)]]
                found += [(some[rows], ids) for rows, ids in self._merged(letters)]
        lengths = np.zeros(len(pieces) + 1, np.int64)
        for rows, ids in found:
            lengths[rows + 1] = ids.shape[1]
        starts = np.cumsum(lengths)
        tokens = np.zeros(starts[-1], np.int32)
        for rows, ids in found:
            tokens[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tokens))

    def documents(self, pieces: pa.ListArray) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
        """(from, to, tokens, bounds): the tokens of some of the documents one after the other, and where each begins."""
        ends = np.asarray(pieces.offsets, np.int64) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        words = coded.dictionary
        at = pc.index_in(words, value_set=self.known)
        missing = np.asarray(pc.is_null(at))
        place = np.where(missing, len(self.known) + np.cumsum(missing) - 1, np.asarray(at.fill_null(0)))
        every = pa.concat_arrays([self.known_ids, self.fold(words.filter(pa.array(missing)))]).take(pa.array(place))
        low = 0
        while low < len(pieces):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + PLACED, "right")) - 1)
            own = every.take(coded.indices.slice(ends[low], ends[high] - ends[low]))
            bounds = np.asarray(own.offsets, np.int64) - own.offsets[0].as_py()
            yield low, high, own.flatten(), bounds[ends[low : high + 1] - ends[low]]
            low = high


def merges_of(docs: DataFrame, vocabulary: Vocabulary) -> Broadcast:
    """The vocabulary with the dictionary of these documents, for the workers."""
    words = frequent_words(docs, vocabulary)
    unreached = vocabulary.unreached_texts()
    if unreached:
        others = docs.sparkSession.createDataFrame(unreached, "piece string, ids array<int>")
        words = words.join(others.select("piece"), "piece", "left_anti").unionByName(others)
    # at most DICTIONARY_ROWS and the unreached tokens
    return docs.sparkSession.sparkContext.broadcast(Merges(vocabulary, words.toArrow()))


def split(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, pieces) of every text."""
    return docs.select("doc_id", pieces(F.col("text"), vocabulary).alias("pieces"))


def decoded(ids: pa.Array, bounds: np.ndarray, tokens: pa.Array) -> Iterator[memoryview]:
    """The bytes that the tokens of each document stand for."""
    own = tokens.take(ids)
    _, offsets, data = own.buffers()
    ends = np.frombuffer(offsets, np.int32)[own.offset : own.offset + len(own) + 1][bounds] if len(own) else np.zeros(len(bounds), np.int32)
    data = memoryview(data or b"")
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield data[low:high]


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Counts and digests of the tokens of every text and of what they decode to."""
    rows = texts(docs)
    shared = merges_of(rows, vocabulary)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, ids, bounds in shared.value.documents(batch.column(1)):
                little_endian = memoryview(np.asarray(ids).astype("<u4")).cast("B")
                packed = [hashlib.sha256(little_endian[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                texts_of = [hashlib.sha256(text).hexdigest() for text in decoded(ids, bounds, shared.value.texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(bounds)), pa.array(packed, pa.string()), pa.array(texts_of, pa.string())], names)

    return split(rows, vocabulary).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
