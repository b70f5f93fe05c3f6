"""SimHash fingerprints and the search within a Hamming radius (DataFrame functions only).

A document's terms are its words, each hashed together with the word after it, so that word
order counts. A term weighs as much as it occurs. Every term votes on each of 64 bits; a bit is
set if more than half of the weight votes for it. A text without words has fingerprint 0.

Votes are summed four bits at a time: `hash >>> i & 0x0001000100010001` holds bits i, i + 16,
i + 32 and i + 48 in four lanes of 16 bits, so 16 sums of longs count all 64 bits of up to
CHUNK terms. Longer texts are summed chunk by chunk, and the unpacked counts then added up.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import stored, texts

BITS = 64
LANES = 0x0001000100010001
CHUNK = 65_535
SPACES = r"[ \t\n\x0B\f\r]+"


def term_hashes(text: Column) -> Column:
    """One 64-bit hash for each word with its follower; the last word stands alone."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _signs(second: Column) -> Column:
    """The fingerprint of the first or second text: the bits with more than half of its votes."""
    weight = F.sum(F.when(second, F.col("_weight")).otherwise(0))
    bits = []
    for bit in range(BITS):
        votes = F.shiftrightunsigned(f"_v{bit % 16}", bit // 16 * 16).bitwiseAND(F.lit(0xFFFF))
        mask = (1 << bit) - (1 << 64 if bit == 63 else 0)
        count = F.sum(F.when(second, votes).otherwise(0))
        bits.append(F.when(count * 2 > weight, F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [reduce(lambda a, b: a.bitwiseOR(b), bits[k : k + 4]) for k in range(0, len(bits), 4)]
    return bits[0]


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprints(docs: DataFrame, keys: list[str], first: Column, second: Column) -> DataFrame:
    """keys, fingerprint, second_fingerprint, copies: of two texts of each row, in one pass.

    Rows with equal keys become one, with their number, so the keys must tell different texts apart. Nothing is
    shuffled if the rows already lie together by one of the keys.
    """
    # _row keeps repeated rows apart, so that their sums stay in their lanes
    hashed = docs.select(*keys, F.monotonically_increasing_id().alias("_row"), term_hashes(first).alias("_a"), term_hashes(second).alias("_b"))
    terms = hashed.select(*keys, "_row", F.size("_a").alias("_na"), F.posexplode_outer(F.concat("_a", "_b")).alias("_i", "_h"))
    placed = terms.withColumn("_second", F.coalesce(F.col("_i") >= F.col("_na"), F.lit(False))).withColumn(
        "_chunk", F.floor((F.col("_i") - F.when(F.col("_second"), F.col("_na")).otherwise(0)) / CHUNK)
    )
    lanes = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(LANES))).alias(f"_v{i}") for i in range(16)]
    # of each row one term, or the one row of a text without any, is the first
    first_term = F.sum(F.when(F.coalesce(F.col("_i"), F.lit(0)) == 0, 1).otherwise(0)).alias("_first")
    counted = placed.groupBy(*keys, "_row", "_second", "_chunk").agg(F.count("_h").alias("_weight"), first_term, *lanes)
    return counted.groupBy(*keys).agg(
        _signs(~F.col("_second")).alias("fingerprint"), _signs(F.col("_second")).alias("second_fingerprint"), F.sum("_first").alias("copies")
    )


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, n_chars, next_id): the next smaller id, and the largest one after the smallest.

    `ids` holds distinct ids. They are dealt out in ranges; a window runs in each range, and the
    end of a range takes the start of the next one from a table of one row a range.
    """
    ranged = stored(ids.repartitionByRange("doc_id").withColumn("_range", F.spark_partition_id()), "ids")
    ends = ranged.groupBy("_range").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    last = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = ends.select(
        F.col("_low").alias("_end"), F.coalesce(F.lag("_high").over(Window.orderBy("_range")), F.last("_high").over(last)).alias("_other")
    )
    inside = ranged.withColumn("_inside", F.lead("doc_id").over(Window.partitionBy("_range").orderBy(F.desc("doc_id"))))
    return inside.join(below, inside["doc_id"] == below["_end"], "left").select(
        "doc_id", "n_chars", F.coalesce("_inside", "_other").alias("next_id")
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, edited): each text, and its copy whose last third the next document replaced.

    The last floor(n / 3) characters give way to as many, or all, first ones of the document
    with the next smaller id (the smallest id is followed by the largest). Of several rows with
    one id the smallest text is the one that is taken from. Ids must not be null.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    chain = stored(successors(ids), "next")
    takers = chain.select(F.col("doc_id").alias("_taker"), F.col("next_id").alias("_giver"), F.floor(F.col("n_chars") / 3).cast("int").alias("_take"))
    # both joins read the texts dealt out by doc_id, which Spark shuffles once
    given = (
        docs.join(takers, docs["doc_id"] == takers["_giver"])
        .select("_taker", "_giver", F.expr("substring(text, 1, _take)").alias("_given"))
        .groupBy("_taker", "_giver")
        .agg(F.min("_given").alias("_given"))
    )
    return docs.join(given, docs["doc_id"] == given["_taker"], "left").select(
        "doc_id", "text", F.col("_giver").alias("next_id"), edited(F.coalesce("_given", F.lit(""))).alias("edited")
    )


def edited(given: Column) -> Column:
    cut = F.floor(F.length("text") / 3).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(given, F.lit(1), cut))


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of `blocks - radius` of `blocks` equal blocks of bits, every choice of them.

    Fingerprints that differ in at most `radius` bits differ in at most so many blocks, so they
    agree under at least one mask. Six blocks and radius 3 give 20 tables with keys of about 32
    bits, enough to tell some 10^9 fingerprints apart.
    """
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    bits = [((1 << bounds[k + 1]) - 1) ^ ((1 << bounds[k]) - 1) for k in range(blocks)]
    return [sum(bits[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, fingerprint): each distinct query fingerprint with all index ones at most `radius` bits away.

    Both inputs have a column `fingerprint`; equal ones are collapsed first, so a group of copies
    is one row of the index. The tables of permuted blocks are joined on (table, masked bits);
    the distance is then checked in full.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, radius)]
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(m).cast("long").alias("m")) for k, m in enumerate(signed)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        tabled = df.select(F.col("fingerprint").alias(name)).distinct().select(name, F.inline(tables))
        return tabled.select(name, "t", F.col(name).bitwiseAND(F.col("m")).alias("_key"))

    pairs = keyed(queries, "query").join(keyed(index, "fingerprint"), ["t", "_key"])
    near = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint"))) <= radius
    return pairs.where(near).select("query", "fingerprint").distinct()


def edited_likeness(docs: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """Fingerprints of all texts and of their edited copies, and how alike they stay.

    One row for each input row. n_within is, for ids divisible by `every`, the
    number of documents within `radius` bits, itself included; null for other ids. A null text
    is empty. A null id has no next document: its edited text ends where the last third began, and
    its near_next is null.
    """
    rows = texts(docs)
    keys = ["doc_id", "next_id", "n_chars", "edited_sha256", "_text"]

    def printed(paired: DataFrame) -> DataFrame:
        length, digest = F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256")
        keyed = paired.select("doc_id", "next_id", length, digest, F.xxhash64("text").alias("_text"), "text", "edited")
        return fingerprints(keyed, keys, F.col("text"), F.col("edited"))

    alone = rows.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("long").alias("next_id"), edited(F.lit("")).alias("edited"))
    # stored apart: under a union Spark would not see that both text exchanges are the same
    prints = stored(printed(with_next(rows.where("doc_id IS NOT NULL"))), "prints").union(stored(printed(alone), "prints"))
    nexts = prints.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_next")).agg(F.min("fingerprint").alias("_next_print"))
    asked = prints.where(F.col("doc_id") % every == 0)
    sizes = prints.groupBy(F.col("fingerprint").alias("_other")).agg(F.sum("copies").alias("_copies"))
    found = within_radius(asked, prints, radius)
    near = found.join(sizes, found["fingerprint"] == sizes["_other"]).groupBy(F.col("query").alias("_print")).agg(F.sum("_copies").alias("_within"))
    asked_ids = asked.join(near, asked["fingerprint"] == near["_print"]).select(F.col("doc_id").alias("_asked"), F.col("_text").alias("_asked_text"), "_within")
    joined = prints.join(nexts, prints["next_id"] == nexts["_next"], "left").join(
        asked_ids, (F.col("doc_id") == F.col("_asked")) & (F.col("_text") == F.col("_asked_text")), "left"
    )
    each = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex16(F.col("fingerprint")).alias("fingerprint"),
        hex16(F.col("second_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("second_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"),
        F.col("_within").alias("n_within"),
    )
