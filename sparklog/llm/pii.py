"""Personal data, and the terms that disclose it, by information content.

Base: email addresses, IP addresses, card and phone numbers, by pattern and check. They are the
protected entities. The corpus then tells which other terms give an entity away. A term (a word
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased, outside all entities) co-occurs with an entity if
both stand in a document, however far apart. Beside the entity itself its group (an email's domain,
the first parts of an IP, card or phone number) and its kind are keys, so an entity that stands in
one text only is judged by what discloses its group or kind. With N documents and document counts f,

    IC(k) = log2(N / f(k))        PMI(k; t) = log2(N f(k, t) / (f(k) f(t)))

and PMI / IC is the share of the key's information that the term discloses. From REMOVE on every
place of the term in the key's documents is removed, from GENERALISE on replaced by the class of its
form: number, code, name or word. A pair counts only if chance explains it badly: Chernoff's bound for
that many different texts with both has to fall below CHANCE over all pairs tested. A key of one text meets
each word of it, whatever the word, and is not tested itself.

All counts are over all documents. The f(t) of candidate terms are counted in a second pass,
behind a bitmap of fixed size; what passes it by chance is dropped by a join.

Null texts are empty. Rows with equal doc_id and text share their result; every input row gives
one output row, and each counts as a document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import stored, texts
from sparklog.llm.words import NOT_WORDS, Words, slices

KINDS = ("email", "ip", "card", "phone")
#: Probability that chance alone makes any pair of the whole corpus pass.
CHANCE = 0.05
GENERALISE, REMOVE = 0.6, 0.9
#: Bits of the candidate terms' bitmap, which is sent to all tasks.
BITMAP = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails at its start fails everywhere, so the search may skip its inside
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, from one @ to the next, so that long runs cost their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then by start."""
    found = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def keys(kind: str, value: str) -> tuple[str, str, str]:
    """The keys of an entity: itself, its group and its kind."""
    value = value.lower()
    digits = "".join(_DIGIT.findall(value))
    group = {"email": value.rpartition("@")[2], "ip": value.rpartition(".")[0], "card": digits[:6], "phone": digits[:4]}[kind]
    return f"{kind}:{value}", f"{kind} group:{group}", kind


def _terms(text: str, found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of all words of the text outside its entities."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), NOT_WORDS)
    point = np.cumsum((data & 0xC0) != 0x80) - 1  # the code point that each byte belongs to
    start, end = point[words.start], point[words.end - 1] + 1
    inside = np.zeros(len(start), np.bool_)
    for _, a, b in found:
        inside[int(np.searchsorted(end, a, "right")) : int(np.searchsorted(start, b, "left"))] = True
    return words.hash[~inside].view(np.int64), start[~inside].astype(np.int32), end[~inside].astype(np.int32)


BASE_SCHEMA = (
    "doc_id long, text_key binary, kinds array<string>, starts array<int>, ends array<int>, keys array<string>, "
    "words array<struct<term:bigint,start:int,end:int>>"
)


def base_spans(docs: DataFrame) -> DataFrame:
    """Per document its entities, their keys and its other words; text_key tells different texts apart."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words, named = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                own = entities(text)
                found.append(own)
                words.append(_terms(text, own) if own else none)
                named.append(sorted({key for kind, a, b in own for key in keys(kind, text[a:b])}))
            columns = [pa.array([[e[k] for e in own] for own in found], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            offsets = np.cumsum([0, *[len(w[0]) for w in words]]).astype(np.int32)
            flat = [np.concatenate([w[k] for w in words] or [none[k]]) for k in range(3)]
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(f) for f in flat], ["term", "start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *columns, pa.array(named, pa.list_(pa.string())), listed],
                ["doc_id", "text_key", "kinds", "starts", "ends", "keys", "words"],
            )

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(run, BASE_SCHEMA)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def term_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(term, f): in how many documents each candidate term stands."""
    bits = candidates.select(F.pmod("term", F.lit(BITMAP)).alias("bit")).distinct()
    chunks = bits.groupBy((F.col("bit") / 4096).cast("int").alias("chunk")).agg(F.collect_list((F.col("bit") % 4096).cast("short")).alias("bits"))
    bitmap = np.zeros(BITMAP, np.bool_)
    for row in chunks.toLocalIterator():  # at most BITMAP short numbers
        bitmap[row["chunk"] * 4096 + np.array(row["bits"], np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = np.unpackbits(shared.value).astype(np.bool_)
        for batch in batches:
            parts = [np.zeros(0, np.uint64)]
            for low, high, data, bounds in slices(batch.column(0)):
                words = Words(data, bounds, NOT_WORDS)
                maybe = listed[(words.hash & np.uint64(BITMAP - 1)).astype(np.int64)]
                for k in range(high - low):
                    own = slice(words.first[k], words.first[k + 1])
                    parts.append(np.unique(words.hash[own][maybe[own]]))
            terms, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "f"])

    counted = docs.select("text").mapInArrow(run, "term long, f long").groupBy("term").agg(F.sum("f").alias("f"))
    return counted.join(candidates.select("term").distinct(), "term")


def _unlikely(shared: Column, draws: Column, rate: Column) -> Column:
    """-ln of Chernoff's bound for at least `shared` hits in so many draws at the rate; 0 if no more than expected."""
    share = shared / draws
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    return F.when((share > rate) & (rate < 1), draws * (share * F.log(share / rate) + rest)).otherwise(0.0)


def disclosing(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(key, term, share): the pairs whose term discloses at least GENERALISE of the key, beyond chance."""
    total = float(max(base.count(), 1))
    held = base.where(F.size("keys") > 0)
    terms = F.array_distinct(F.transform("words", lambda w: w["term"]))
    # copies of a text are one observation
    once = stored(held.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first(terms).alias("terms")), "entity-texts")
    tested = once.agg(F.coalesce(F.sum(F.size("keys").cast("double") * F.size("terms")), F.lit(0.0))).first()[0]
    least = math.log(max(tested, 1.0) / CHANCE)
    # x texts with a key and a term bound the exponent by this, which grows up to total / e
    most = F.col("texts") * F.log(total / F.col("texts"))
    alone = once.select("copies", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("copies").alias("fk"), F.count(F.lit(1)).alias("texts"))
    alone = stored(alone.where((F.col("texts") > 1) & ((most >= least) | (F.col("texts") > total / math.e))).select("key", "fk"), "keys")
    # keys that no term can pass with are left out before their texts' words are listed
    few = once.select("text_key", F.explode("keys").alias("key")).join(alone.select("key"), "key").groupBy(F.col("text_key").alias("_key")).agg(F.collect_list("key").alias("own"))
    tried = once.join(few, F.col("text_key") == F.col("_key")).select("copies", "terms", F.explode("own").alias("key"))
    pairs = tried.select("copies", "key", F.explode("terms").alias("term"))
    met = pairs.groupBy("key", "term").agg(F.sum("copies").alias("fkt"), F.count(F.lit(1)).alias("texts"))
    possible = stored(met.where((F.col("texts") > 1) & (most >= least)), "pairs")
    joined = possible.join(term_counts(docs, possible), "term").join(alone, "key")
    bits = F.log2(total * F.col("fkt") / (F.col("fk") * F.col("f")))
    content = F.log2(total / F.col("fk"))
    unlikely = F.greatest(_unlikely(F.col("texts"), F.col("f"), F.col("fk") / total), _unlikely(F.col("texts"), F.col("fk"), F.col("f") / total))
    return joined.where(unlikely >= least).select("key", "term", F.when(content > 0, bits / content).alias("share")).where(F.col("share") >= GENERALISE)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, added): spans (kind, start, end), the base ones and the method's.

    Base spans are ordered by kind and start; added ones, `generalise` before `remove`, likewise.
    """
    rows = texts(docs)
    base = stored(base_spans(rows), "entities")
    shares = stored(disclosing(rows, base), "shares")
    held = base.where(F.size("keys") > 0).select("doc_id", "text_key", "keys", F.array_distinct(F.transform("words", lambda w: w["term"])).alias("terms"))
    # the terms that disclose anything first, so that few of a text's words are met with its keys
    listed = held.select("doc_id", "text_key", "keys", F.explode("terms").alias("term")).join(shares.select("term").distinct(), "term", "left_semi")
    paired = listed.select("doc_id", "text_key", "term", F.explode("keys").alias("key")).join(shares, ["key", "term"])
    strongest = paired.groupBy("doc_id", "text_key", "term").agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    marks = strongest.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("term", kind))).alias("marks"))
    joined = base.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    placed = F.transform("words", lambda w: F.struct(F.try_element_at("marks", w["term"]).alias("kind"), w["start"].alias("start"), w["end"].alias("end")))
    added = F.when(F.col("marks").isNotNull(), F.array_sort(F.filter(placed, lambda w: w["kind"].isNotNull()))).alias("added")
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.struct(s["kinds"].alias("kind"), s["starts"].alias("start"), s["ends"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select("doc_id", "text_key", spans.alias("base"), F.coalesce(added, none).alias("added"))


def listing(docs: DataFrame) -> DataFrame:
    """Counts and digests of what `find` gives, one row for each document."""
    found = find(docs)

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    every = F.concat_ws(",", F.when(F.size("base") > 0, joined("base")), F.when(F.size("added") > 0, joined("added")))
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), every.alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): entities replaced by their kind, generalised terms by the class of their form, removed terms cut out."""
    found = find(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.concat("base", "added").alias("spans")).where(F.size("spans") > 0)
    once = found.groupBy("_id", "_key").agg(F.first("spans").alias("spans"))
    rows = texts(docs)
    joined = rows.join(once, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [replaced(text, spans or []) for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["doc_id", "text"])

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def form(word: str) -> str:
    """The class that a generalised term is replaced by."""
    if any("0" <= c <= "9" for c in word):
        return "NUMBER" if word.isdigit() else "CODE"
    return "NAME" if word[:1].isupper() else "WORD"


def replaced(text: str, spans: list[dict]) -> str:
    """The text with its spans replaced; of overlapping ones the first, then the longest, holds."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] < at:
            continue
        word = text[span["start"] : span["end"]]
        mark = {"remove": "", "generalise": f"[{form(word)}]"}.get(span["kind"], f"[{span['kind'].upper()}]")
        out += [text[at : span["start"]], mark]
        at = span["end"]
    return "".join([*out, text[at:]])
