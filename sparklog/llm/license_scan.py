"""License scan by ordered signature rules (DataFrame functions only).

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. The base finds
three phrases by consecutive words. Texts are joined by single spaces, and the rules whose keyword they
hold are located in them. A match is suppressed if
another of the same or a higher rank contains it, or if it overlaps one of a higher rank; of
equal spans and ranks the earlier rule stays. What is left gives the labels.

Null texts are empty. Rows with equal doc_id and text count as one document and share their
result; every input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import stored, texts
from sparklog.llm.license_rules import all_rules

#: The phrases of the base and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RANKS = (1, 2, 3)


def words_of(text: Column) -> Column:
    """The words; lower-casing other letters too splits them alike, and makes no ASCII phrase that was none."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, n_words, _places, _keywords, _joined) of every row, in one pass over the texts.

    _text tells different texts of one id apart. _places are the base's. _keywords are those of the
    rules that the text holds, looked for only if their first word is one of its words; _joined has
    the words of texts with a keyword, joined by spaces. All three are null in most texts.
    """
    keywords = sorted({r.keyword for r in all_rules()})
    first_words = sorted({k.split()[0] for k in [*keywords, *(phrase for phrase, _ in PHRASES)]})
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(k.split()[0]).alias("first")) for k in keywords])
    firsts = F.array(*map(F.lit, first_words))

    def scanned(joined: Column, present: Column) -> Column:
        own = F.transform(F.filter(table, lambda k: F.array_contains(present, k["first"]) & joined.contains(k["keyword"])), lambda k: k["keyword"])
        phrase = reduce(lambda x, y: x | y, [joined.contains(phrase) for phrase, _ in PHRASES])
        return let(own, lambda k: F.struct(phrase.alias("phrase"), F.when(F.size(k) > 0, k).alias("keywords"), F.when(F.size(k) > 0, joined).alias("joined")))

    words = texts(docs).select("doc_id", F.xxhash64("text").alias("_text"), words_of(F.col("text")).alias("a"))
    found = let(F.array_join("a", " "), lambda joined: let(F.array_intersect(firsts, F.col("a")), lambda present: scanned(joined, present)))
    gated = words.select("doc_id", "_text", "a", F.when(F.arrays_overlap("a", firsts), found).alias("_s"))
    zipped = F.arrays_zip(F.col("a").alias("a"), F.slice("a", 2, F.size("a")).alias("b"), F.slice("a", 3, F.size("a")).alias("c"))
    return gated.select(
        "doc_id",
        "_text",
        F.size("a").cast("long").alias("n_words"),
        F.when(F.col("_s.phrase"), _labelled(zipped)).alias("_places"),
        F.col("_s.keywords").alias("_keywords"),
        F.col("_s.joined").alias("_joined"),
    )


def _labelled(three: Column) -> Column:
    def label(w: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, name in PHRASES:
            own = [w[k] == part for k, part in zip("abc", phrase.split(), strict=False)]
            found = F.when(reduce(lambda x, y: x & y, own), name).otherwise(found)
        return found

    each = F.transform(three, lambda w, at: F.struct(at.cast("long").alias("at"), label(w).alias("label")))
    return F.filter(each, lambda p: p["label"].isNotNull())


def rule_hits(rows: DataFrame) -> DataFrame:
    """(doc_id, _text, start, end, rank, rule, label): every match of every rule, unsuppressed.

    start and end count characters of the words joined by single spaces.
    """
    rules = all_rules()
    table = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(rf"(?<![^ ])(?:{r.pattern})(?![^ ])").alias("pattern"), F.lit(r.rank).alias("rank"))
            for n, r in enumerate(rules)
        ]
    )
    gated = rows.where("_joined IS NOT NULL").select("doc_id", "_text", "_keywords", "_joined").dropDuplicates(["doc_id", "_text"])
    own = F.filter(table, lambda r: F.array_contains(F.col("_keywords"), r["keyword"]))
    tried = gated.select("doc_id", "_text", "_joined", F.explode(own).alias("_r"))
    matched = tried.select(
        "doc_id", "_text", "_r.rule", "_r.label", "_r.rank",
        F.expr("regexp_extract_all(_joined, _r.pattern, 0)").alias("_found"),
        F.expr("split(_joined, _r.pattern)").alias("_between"),
    ).where(F.size("_found") > 0)
    each = matched.select("doc_id", "_text", "rule", "label", "rank", F.posexplode(F.arrays_zip("_between", "_found")).alias("_n", "_part"))
    # the pieces before a match, added up, give its place
    before = Window.partitionBy("doc_id", "_text", "rule").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.length("_part._found"), F.lit(0))
    placed = each.withColumn("end", F.sum(F.coalesce(F.length("_part._between"), F.lit(0)) + own).over(before))
    return placed.where(F.col("_part._found").isNotNull()).select("doc_id", "_text", (F.col("end") - own).alias("start"), "end", "rank", "rule", "label")


def unsuppressed(hits: DataFrame) -> DataFrame:
    """The hits that no other one contains at its rank or above, nor overlaps above its rank."""
    order = [F.col("start"), F.desc("end"), F.desc("rank"), F.col("rule")]
    earlier = Window.partitionBy("doc_id", "_text").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("doc_id", "_text").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    dropped = F.lit(False)
    for rank in RANKS:
        reach = F.max(F.when(F.col("rank") >= rank, F.col("end"))).over(earlier)
        above = F.max(F.when(F.col("rank") > rank, F.col("end"))).over(earlier)
        next_above = F.min(F.when(F.col("rank") > rank, F.col("start"))).over(later)
        covered = F.coalesce(reach >= F.col("end"), F.lit(False))
        crossed = F.coalesce(above > F.col("start"), F.lit(False)) | F.coalesce(next_above < F.col("end"), F.lit(False))
        dropped = F.when(F.col("rank") == rank, covered | crossed).otherwise(dropped)
    return hits.withColumn("_dropped", dropped).where(~F.col("_dropped")).drop("_dropped")


def scan(docs: DataFrame) -> DataFrame:
    """Word counts, base places and all labels, one row for each document.

    score is the highest rank of what is left, over 3, and at least 0.5 if the base found a place.
    """
    base = stored(prepared(docs), "licenses")
    found = (
        unsuppressed(rule_hits(base))
        .groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"))
        .agg(F.collect_set("label").alias("_labels"), F.max("rank").alias("_rank"))
    )
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    places = F.coalesce(F.col("_places"), F.array().cast("array<struct<at:bigint,label:string>>"))
    rows = joined.select("doc_id", "n_words", places.alias("_places"), F.coalesce("_labels", F.array().cast("array<string>")).alias("_labels"), "_rank")
    base_labels = F.array_distinct(F.col("_places.label"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places.at").alias("first_word"),
        F.array_max("_places.at").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("_labels"))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("_rank") / 3.0, F.lit(0.0)), F.when(F.size("_places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
