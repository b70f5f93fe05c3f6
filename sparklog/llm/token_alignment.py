"""Alignment of two tokenizers' tokens over the same bytes, by lockstep vectorised merging.

Each text is encoded by a byte-level tokenizer (A, with a space before the text) and by a sentence-piece
model (B, which adds that space). Byte offsets at which tokens of both end cut the tokens into groups; all
pairs of an A and a B token of a group are links.

Long texts are dealt into lanes at single spaces between visible Latin characters, where tokens of both
tokenizers end; each lane is encoded by itself. A's ids come from a faster library with the same vocabulary where
both class all characters alike, else from its own. A state vector holds, for every lane of a slice of
documents, the A and the B token it is at and where its group began. One step moves all lanes:
the token that ends first is passed, and where both end at one offset the group is closed, its cut and
its links are emitted, and lanes that are done leave the vector. Links are emitted as the rectangle of
their group, and are counted by pair of ids; of a group of more than WIDE links only the distinct ids are multiplied
out, so that a long text without common ends doesn't expand into all its pairs.

A pair's count is the number of documents (rows) that hold it linked. It is added up in each task
first. Then every document needs the counts of its pairs: those of the FREQUENT most common pairs at most are
broadcast, the others are joined by pair. No pair is left out.

Null and empty texts, and texts whose tokens' bytes joined are not the text, have no tokens: all numbers
are 0 and the digest is empty. Rows are independent: repeated rows and null ids each give a result row and
count as documents of their own. An empty table gives no row.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.byte_level import byte_of_character
from sparklog.llm.common import stored, texts
from sparklog.llm.token_counts import BYTE_LEVEL_PATTERN, checked

#: Characters after which a text may go on in another lane.
LANE_CHARS = 1024
#: Characters of the documents that are encoded and merged at once; a longer text is worked on alone.
SLICE_CHARS = 1 << 20
#: Links of a group beyond which only its distinct ids are multiplied out.
WIDE = 4096
#: Pairs whose counts are broadcast, 17 bytes each.
FREQUENT = 1 << 20
#: Longer lanes are left to the slower library, whose time doesn't grow with the square of a piece.
FAST_CHARS = 4 * LANE_CHARS
#: Distinct pairs that a task holds before it hands their counts on.
HELD = 1 << 21

LANE_END = re.compile(r"(?<=[!-~\u00A1-\u024F]) (?=[!-~\u00A1-\u024F])")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
SPACE_MARK = "▁"


class Tokenizers:
    """Both tokenizers in one Python worker, and the bytes of their tokens."""

    def __init__(self, json_a: str, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        checked(json.loads(json_a))
        self.a = Tokenizer.from_str(json_a)
        self.a.encode_special_tokens = True
        self.agreed, self.odd = set(map(chr, range(128))), set()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        byte_of = byte_of_character()
        added = {t["id"]: t["content"].encode() for t in json.loads(json_a)["added_tokens"]}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            self.bytes_a[number] = added[number] if number in added else bytes(byte_of[c] for c in entry)
        self.fast = self._fast(json.loads(json_a)["model"])
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [self._piece_bytes(p) for p in pieces]
        # a lane may end before a space only if no piece goes on over it
        self.lanes = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.joined_a, self.joined_b = (np.frombuffer(b"".join(table), np.uint8) for table in (self.bytes_a, self.bytes_b))
        # decimal ids with the sign that follows them: within a group, and at the end of its part
        self.shown_a = np.array([f"{k}{sign}" for sign in ",|" for k in range(len(self.bytes_a))], object)
        self.shown_b = np.array([f"{k}{sign}" for sign in ",;" for k in range(len(self.bytes_b))], object)

    def _fast(self, model: dict):
        """The same merges in a library that is several times faster; it takes ids for ranks, so these must agree."""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"]["".join(m)] != 256 + k for k, m in enumerate(merges)):
            return None
        ranks = {self.bytes_a[number]: number for number in model["vocab"].values()}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        byte = BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode()

    def parts(self, text: str) -> list[str]:
        """The lanes of a text, without the single space between one and the next."""
        found, low = [], 0
        while self.lanes and len(text) - low > LANE_CHARS and (end := LANE_END.search(text, low + LANE_CHARS)):
            found.append(text[low : end.start()])
            low = end.end()
        return [*found, text[low:]]

    def _learn(self, chars: set[str]) -> None:
        """Ask both libraries how they class characters: whether each goes on a word, a number, signs.

        The second one tells by a vocabulary in which each probe is a token if it is not split.
        """
        probes = {before + char: 256 + k for k, (char, before) in enumerate((c, b) for c in sorted(chars) for b in "a1!")}
        ranks = {bytes([b]): b for b in range(256)} | {text.encode(): number for text, number in probes.items()}
        asked = tiktoken.Encoding("probe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        split = self.a.pre_tokenizer.pre_tokenize_str
        same = {text: (len(split(text)) == 1) == (len(asked.encode_ordinary(text)) == 1) for text in probes}
        for char in chars:
            (self.agreed if all(same[before + char] for before in "a1!") else self.odd).add(char)

    def encoded(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all lanes on end, how many each lane has) of both tokenizers, each lane with a space before it."""
        if new := set().union(*parts) - self.agreed - self.odd:
            self._learn(new)
        ids_a = [
            self.fast.encode_ordinary(f" {part}")
            if self.fast and len(part) <= FAST_CHARS and (not self.odd or self.odd.isdisjoint(part))
            else self.a.encode(f" {part}", add_special_tokens=False).ids
            for part in parts
        ]
        found = []
        for own in (ids_a, self.b.encode(parts, num_threads=1)):
            counts = np.fromiter(map(len, own), np.int64, len(own))
            found.append((np.fromiter(chain.from_iterable(own), np.int64, int(counts.sum())), counts))
        return found


def _differing(lanes: np.ndarray, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, joined: np.ndarray, wanted: list[bytes]) -> set[int]:
    """Those of the `lanes` whose tokens' bytes are not the wanted ones."""
    after = np.concatenate([[0], np.cumsum(sizes[ids])])
    last = np.cumsum(counts)
    lengths = after[last] - after[last - counts]
    same = lengths == np.array([len(w) for w in wanted], np.int64)
    kept = np.repeat(same, counts)
    size = sizes[ids[kept]]
    begins = np.cumsum(sizes) - sizes
    place = np.repeat(begins[ids[kept]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text = np.frombuffer(b"".join(w for w, s in zip(wanted, same, strict=True) if s), np.uint8)
    owner = np.repeat(lanes[same], lengths[same])
    return {*lanes[~same].tolist(), *np.unique(owner[joined[place] != text]).tolist()}


_LOADED: dict[int, Tokenizers] = {}


def _tokenizers(spec: tuple[str, bytes]) -> Tokenizers:
    """This Python worker's tokenizers, loaded once."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(*spec)
        gc.freeze()  # the collector need not walk the vocabularies again and again
    return _LOADED[key]


def merged(ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The groups of all lanes, as rows (first A token, after it, first B token, after it), in order of tokens.

    `ends_*` are the byte ends of all tokens of all lanes on end, `from_*` the first token of each lane and
    `last` the A token after its last. Both tokenizers of a lane end at one offset.
    """
    at_a, at_b = from_a.copy(), from_b.copy()
    group_a, group_b = from_a.copy(), from_b.copy()
    found = []
    while len(at_a):
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        at_a = at_a + (end_a <= end_b)
        at_b = at_b + (end_b <= end_a)
        cut = np.flatnonzero(end_a == end_b)
        if len(cut):
            to_a, to_b = at_a[cut], at_b[cut]
            found.append((group_a[cut], to_a, group_b[cut], to_b))
            group_a[cut], group_b[cut] = to_a, to_b
            if (to_a == last[cut]).any():
                going = at_a < last
                at_a, at_b, group_a, group_b, last = (v[going] for v in (at_a, at_b, group_a, group_b, last))
    groups = np.stack([np.concatenate(part) for part in zip(*found, strict=True)], axis=1) if found else np.zeros((0, 4), np.int64)
    return groups[np.argsort(groups[:, 0], kind="stable")]


def linked_pairs(groups: np.ndarray, owner: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links): how many links of each pair a * base + b of ids every document has, by document and pair."""
    size_a, size_b = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    wide = size_a * size_b > WIDE
    small = np.flatnonzero(~wide)
    links = (size_a * size_b)[small]
    group = np.repeat(small, links)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    a = groups[group, 0] + nth // size_b[group]
    b = groups[group, 2] + nth % size_b[group]
    documents, pairs = owner[group], ids_a[a] * base + ids_b[b]
    by = np.lexsort((pairs, documents))
    documents, pairs, numbers = documents[by], pairs[by], np.ones(len(by), np.int64)
    if wide.any():
        more = [(documents, pairs, numbers)]
        for k in np.flatnonzero(wide):
            x, nx = np.unique(ids_a[groups[k, 0] : groups[k, 1]], return_counts=True)
            y, ny = np.unique(ids_b[groups[k, 2] : groups[k, 3]], return_counts=True)
            more.append((np.full(len(x) * len(y), owner[k]), (x[:, None] * base + y).ravel(), (nx[:, None] * ny).ravel()))
        documents, pairs, numbers = (np.concatenate(part) for part in zip(*more, strict=True))
        by = np.lexsort((pairs, documents))
        documents, pairs, numbers = documents[by], pairs[by], numbers[by]
    if not len(pairs):
        return documents, pairs, numbers
    first = np.flatnonzero(np.concatenate([[True], (np.diff(documents) != 0) | (np.diff(pairs) != 0)]))
    return documents[first], pairs[first], np.add.reduceat(numbers, first)


class _Slice:
    """Some documents, encoded and merged."""

    def __init__(self, tokenizers: Tokenizers, values: list[str]):
        parts = [(number, part) for number, text in enumerate(values) if text for part in tokenizers.parts(text)]
        ids = tokenizers.encoded([part for _, part in parts])
        of_lane = np.array([number for number, _ in parts], np.int64)
        wanted = [b" " + part.encode() for _, part in parts]
        (flat_a, counts_a), (flat_b, counts_b) = ids
        flat, counts = [flat_a, flat_b], [counts_a, counts_b]
        tables = ((tokenizers.sizes_a, tokenizers.joined_a), (tokenizers.sizes_b, tokenizers.joined_b))
        other = set().union(*(_differing(of_lane, i, n, *table, wanted) for i, n, table in zip(flat, counts, tables, strict=True)))
        if other:  # documents that either tokenizer changes have no tokens
            kept = ~np.isin(of_lane, list(other))
            flat = [i[np.repeat(kept, n)] for i, n in zip(flat, counts, strict=True)]
            counts, of_lane = [n[kept] for n in counts], of_lane[kept]
        (self.a, self.b), (count_a, count_b) = flat, counts
        last = np.cumsum(count_a)
        ends_a, ends_b = np.cumsum(tokenizers.sizes_a[self.a]), np.cumsum(tokenizers.sizes_b[self.b])
        self.groups = merged(ends_a, ends_b, last - count_a, np.cumsum(count_b) - count_b, last)
        documents = len(values)
        owner_a, owner_b = np.repeat(of_lane, count_a), np.repeat(of_lane, count_b)
        self.owner = owner_a[self.groups[:, 0]] if len(self.groups) else np.zeros(0, np.int64)
        self.n_a, self.n_b = np.bincount(owner_a, minlength=documents), np.bincount(owner_b, minlength=documents)
        self.n_groups = np.bincount(self.owner, minlength=documents)
        base = len(tokenizers.bytes_b)
        document, self.pairs, self.numbers = linked_pairs(self.groups, self.owner, self.a, self.b, base)
        self.first = np.searchsorted(document, np.arange(documents + 1))
        self.listings = self._listings(tokenizers, documents)

    def _listings(self, tokenizers: Tokenizers, documents: int) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of every document: its groups, the A ids of each before its B ids."""
        if not len(self.groups):
            return [""] * documents
        from_a, to_a, from_b, to_b = self.groups.T
        shown = np.empty(len(self.a) + len(self.b), object)
        group_a, group_b = np.repeat(np.arange(len(self.groups)), to_a - from_a), np.repeat(np.arange(len(self.groups)), to_b - from_b)
        number_a, number_b = np.arange(len(self.a)), np.arange(len(self.b))
        ends_part_a, ends_part_b = number_a + 1 == to_a[group_a], number_b + 1 == to_b[group_b]
        shown[number_a + from_b[group_a]] = tokenizers.shown_a[self.a + ends_part_a * len(tokenizers.bytes_a)]
        shown[number_b + to_a[group_b]] = tokenizers.shown_b[self.b + ends_part_b * len(tokenizers.bytes_b)]
        bounds = np.cumsum(np.concatenate([[0], self.n_a + self.n_b]))
        return ["".join(shown[a:b].tolist())[:-1] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) in slices of bounded size."""
    low, some, size = 0, [], 0
    for value in column:
        some.append(value.as_py())
        size += len(some[-1])
        if size >= SLICE_CHARS:
            yield low, some
            low, some, size = low + len(some), [], 0
    if some:
        yield low, some


def aligned(docs: DataFrame, spec, with_groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, numbers) of every row.

    `groups` is the listing of the groups, null unless asked for; groups_sha256 is its digest. `pairs`
    holds the distinct linked pairs of ids, a * size of B + b in 8 bytes each, `numbers` their links. `row` numbers
    the rows of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(spec.value)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, values in _slices(batch.column(1)):
                s = _Slice(tokenizers, values)
                bounds = s.first.tolist()
                spans = list(zip(bounds[:-1], bounds[1:], strict=True))
                links = np.concatenate([[0], np.cumsum(s.numbers)])[s.first]
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in s.listings]
                columns = [
                    pa.array(range(row, row + len(values)), pa.int64()),
                    batch.column(0).slice(low, len(values)),
                    *(pa.array(v, pa.int64()) for v in (s.n_a, s.n_b, s.n_groups, np.diff(links))),
                    pa.array(digests, pa.string()),
                    pa.array(s.listings if with_groups else [None] * len(values), pa.string()),
                    pa.array([s.pairs[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([s.numbers[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                ]
                row += len(values)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "numbers"])

    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, numbers binary"
    return texts(docs).mapInArrow(run, kinds)


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column on end, and where each row's begin."""
    parts = [np.frombuffer(v.as_buffer(), kind) for v in column]
    bounds = np.cumsum([0, *(len(p) for p in parts)])
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), bounds


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): in how many rows each pair is linked; every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_pairs, held_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for low in range(0, len(batch), 1000):
                pairs, counts = np.unique(_joined(batch.column(0).slice(low, 1000), np.int64)[0], return_counts=True)
                both = np.concatenate([held_pairs, pairs])
                by = np.argsort(both, kind="stable")
                both, counts = both[by], np.concatenate([held_counts, counts])[by]
                if len(both):
                    first = np.flatnonzero(np.concatenate([[True], np.diff(both) != 0]))
                    held_pairs, held_counts = both[first], np.add.reduceat(counts, first)
                if len(held_pairs) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held_pairs), pa.array(held_counts)], ["pair", "n"])
                    held_pairs, held_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held_pairs), pa.array(held_counts)], ["pair", "n"])

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_table(rows: DataFrame, base: int) -> DataFrame:
    """(pair, a, b, n, best): every linked pair of ids, its count, and whether no pair of its A id has a higher one."""
    counts = stored(pair_counts(rows).select("pair", F.expr(f"pair div {base}").alias("a"), (F.col("pair") % base).alias("b"), "n"), "counts")
    # a row for each id of vocabulary A at most, so a broadcast is bounded by the vocabulary
    highest = counts.groupBy(F.col("a").alias("_a")).agg(F.max("n").alias("_n"))
    return counts.join(F.broadcast(highest), F.col("a") == F.col("_a")).select("pair", "a", "b", "n", (F.col("n") == F.col("_n")).alias("best"))


def frequent_links(table: DataFrame, rows: int = FREQUENT) -> pa.Table:
    """(pair, n, best) of the most common pairs by pair, at most `rows` of them."""
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for row in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred levels
        total += row["count"]
        if total > rows:
            break
        least = row["level"]
    chosen = table.where(level >= least) if least is not None else table.limit(0)
    return chosen.select("pair", "n", "best").toArrow().sort_by("pair")


def alignment(docs: DataFrame, json_a: str, model_b: bytes, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`.

    n_best are the links whose pair has the highest count of its A id, ties included; count_sum adds up the
    counts of all links. `json_a` and `model_b` are the contents of the tokenizers' files, which the driver has read.
    """
    context = docs.sparkSession.sparkContext
    spec = context.broadcast((json_a, model_b))
    rows = stored(aligned(docs, spec).drop("groups"), "aligned")
    table = stored(link_table(rows, len(Tokenizers(json_a, model_b).bytes_b)), "links")
    common = frequent_links(table, frequent)
    known = context.broadcast(tuple(common.column(name).to_numpy() for name in ("pair", "n", "best")))

    def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """All pairs of the batch, their links, where each row's begin, and their place among the known, -1 if not there."""
        pairs, bounds = _joined(batch.column("pairs"), np.int64)
        numbers = _joined(batch.column("numbers"), np.int32)[0].astype(np.int64)
        place = np.searchsorted(known.value[0], pairs)
        there = place < len(known.value[0])
        there[there] = known.value[0][place[there]] == pairs[there]
        return pairs, numbers, bounds, np.where(there, place, -1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                some = batch.slice(low, 1000)
                _, numbers, bounds, place = looked_up(some)
                counts, best = np.append(known.value[1], 0)[place], np.append(known.value[2], False)[place]
                sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[bounds]) for v in (numbers * best, numbers * counts)]
                columns = [some.column(name) for name in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in sums)], [*own, "n_best", "count_sum"])

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                some = batch.slice(low, 1000)
                pairs, numbers, bounds, place = looked_up(some)
                absent = place < 0
                numbered = np.repeat(some.column("row").to_numpy(), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(v[absent]) for v in (numbered, pairs, numbers)], ["row", "pair", "links"])

    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = rows.mapInArrow(summed, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    rare = rows.select("row", "pairs", "numbers").mapInArrow(missed, "row long, pair long, links long")
    met = rare.join(table.select(F.col("pair").alias("_pair"), "n", "best"), F.col("pair") == F.col("_pair"))
    links = F.col("links")
    more = met.groupBy(F.col("row").alias("_row")).agg(F.sum(F.when(F.col("best"), links).otherwise(0)).alias("_best"), F.sum(links * F.col("n")).alias("_sum"))
    whole = found.join(more, F.col("row") == F.col("_row"), "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
