"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

Three disjoint parts of a bounded sample of labelled documents are used. From the first comes
the lexicon: words and word beginnings whose log-odds of standing in a toxic document are far
from chance. On the second gradient-boosted trees learn from lexicon densities, second-person
proximity, capitals, punctuation and obfuscation rates. On the third isotonic regression turns
their raw score into a probability.

An empty or null text has all features 0 and gets a score like any other. Rows are independent,
so repeated rows and null ids keep one result each. With too few labels of a kind for three parts the whole
sample serves all three uses. Without labels of both kinds
every score is the share of label 1, or 0 without any, and below PASS: nothing is rejected unlearned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sparklog.llm.common import held_out, packed, stored, texts, unpacked
from sparklog.llm.samples import labelled_sample

PASS = 0.5
#: Most entries of the lexicon, which is sent to all tasks. The terms farthest from chance are kept: of 10,000 documents
#: some 1,000 terms pass DEVIATIONS, so the bound is not met there.
LEXICON_ROWS = 5_000
#: A word counts if its log-odds are so many standard errors from 0.
DEVIATIONS = 2.5
#: Lengths of the word beginnings in the lexicon, in characters.
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5
TREES, DEPTH = 30, 4
#: Rows of each label that a part needs, and that a leaf of a tree holds.
LEAST_IN_PART = 5

# Second-person pronouns of the languages in question.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes tus ti vosotros".split())
# Signs that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"[^\s]+")
_OUTER = ".,;:!?\"'()[]{}<>-–—…"
_INNER_SIGN = re.compile(r"[^\W\d_][0-9@$!|*#_.]+[^\W\d_]|[^\W\d_]\*+")

FEATURES = [
    "words", "lexicon_share", "lexicon_weight", "lexicon_top", "lexicon_kinds", "beginning_share", "beginning_weight", "beginning_top",
    "mild_share", "near_person", "person_share", "capital_words", "capitals", "points", "bangs", "signs", "disguised", "disguised_hits",
]


def terms(word: str) -> list[str]:
    """What a word may have in the lexicon: itself, and its beginnings followed by `*`."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    raw = _WORD.findall(text)
    if not raw:
        return [0.0] * len(FEATURES)
    n, chars = len(raw), len(text)
    words = [w.strip(_OUTER) for w in text.lower().split()]
    own = [lexicon.get(w, 0.0) for w in words]
    begun = [max((lexicon.get(w[:k] + "*", 0.0) for k in BEGINNINGS if len(w) >= k), default=0.0) for w in words]
    hits = [i for i, v in enumerate(own) if v > 0]
    people = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near, k = 0, 0
    for i in hits:
        while k < len(people) and people[k] < i - NEAR:
            k += 1
        near += k < len(people) and people[k] <= i + NEAR
    disguised = [w for w in words if _INNER_SIGN.search(w)] if _INNER_SIGN.search(text) else []
    undone = sum(lexicon.get(w.translate(DISGUISE), 0.0) > 0 for w in disguised)
    positive, starts = [v for v in own if v > 0], [v for v in begun if v > 0]
    return [
        math.log(n),
        len(hits) / n,
        sum(positive) / n,
        max(positive, default=0.0),
        float(len({words[i] for i in hits})),
        len(starts) / n,
        sum(starts) / n,
        max(starts, default=0.0),
        sum(v < 0 for v in own) / n,
        near / n,
        len(people) / n,
        sum(w.isupper() and len(w) > 1 for w in raw) / n,
        sum(map(str.isupper, text)) / chars,
        sum(map(text.count, ".,;:")) / chars,
        sum(map(text.count, "!?")) / chars,
        sum(map(text.count, "*#@$%&")) / chars,
        len(disguised) / n,
        float(undone),
    ]


def lexicon_of(sample: DataFrame) -> dict[str, float]:
    """term: log-odds, of terms that stand in toxic documents far more, or far less, than by chance."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {w.strip(_OUTER) for w in text.as_py().lower().split()}
                found[label].update({term for word in words for term in terms(word)})
        names = [t for t in {**found[0], **found[1]} if t]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([found[0][t] for t in names], pa.int64()), pa.array([found[1][t] for t in names], pa.int64())],
            ["term", "mild", "toxic"],
        )

    sizes = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    mild, toxic = (sizes.get(k, 0) + 1.0 for k in (0, 1))
    counts = sample.select("text", "label").mapInArrow(counted, "term string, mild long, toxic long")
    summed = counts.groupBy("term").agg(F.sum("mild").alias("mild"), F.sum("toxic").alias("toxic")).where("mild + toxic >= 3")
    odds = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("mild") + 0.5) / mild)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("mild") + 0.5))
    kept = summed.select("term", odds.alias("odds"), F.abs(odds / error).alias("far")).where(F.col("far") >= DEVIATIONS)
    return {row["term"]: row["odds"] for row in kept.orderBy(F.desc("far"), "term").limit(LEXICON_ROWS).collect()}


def featured(docs: DataFrame, lexicon: dict[str, float], *keep: str) -> DataFrame:
    """The columns `keep` and the vector `features` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text.as_py(), shared.value) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], [*keep, "features"])

    schema = docs.select(*keep).schema.add("features", ArrayType(DoubleType()))
    return docs.select("text", *keep).mapInArrow(run, schema).withColumn("features", array_to_vector("features"))


def fit(docs: DataFrame, labels: DataFrame) -> Callable[..., DataFrame]:
    """A function from rows with a text, and the columns to keep, to these columns and the score."""
    sample = stored(labelled_sample(docs, labels, "toxic"), "toxic")
    part = F.expr("CASE WHEN part < 4 THEN 0 WHEN part < 8 THEN 1 ELSE 2 END").alias("g")
    found = sample.groupBy(part, "label").agg(F.count("*").alias("n"), F.sum("weight").alias("of")).collect()
    sizes = {(row["g"], row["label"]): row["n"] for row in found}
    if {row["label"] for row in found} != {0, 1}:
        toxic, total = sum(row["of"] for row in found if row["label"]), sum(row["of"] for row in found)
        share = min(toxic / total if total else 0.0, 0.99 * PASS)
        return lambda rows, *keep: rows.select(*keep, F.lit(share).alias("score"))
    apart = all(sizes.get((g, label), 0) >= LEAST_IN_PART for g in (0, 1, 2) for label in (0, 1))
    least = LEAST_IN_PART if apart else 1
    lexicon_part, trees_part, last_part = ("part < 4", "part >= 4 AND part < 8", "part >= 8") if apart else ("true",) * 3
    lexicon = lexicon_of(sample.where(lexicon_part))
    rows = stored(featured(sample if not apart else sample.where("part >= 4"), lexicon, "label", "part", "weight"), "features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=least, seed=7)
    model = trees.fit(rows.where(trees_part).coalesce(4))
    raw = vector_to_array("rawPrediction")[1].alias("raw")
    regression = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight")
    calibrated = regression.fit(model.transform(rows.where(last_part)).select("label", "weight", raw))

    def scored(some: DataFrame, *keep: str) -> DataFrame:
        found = model.transform(featured(some, lexicon, *keep)).select(*keep, raw, vector_to_array("probability")[1].alias("p"))
        # a little of the trees' own probability keeps the order within a step
        blend = calibrated.transform(found).withColumn("score", F.col("prediction") * 0.98 + F.col("p") * 0.02)
        return blend.select(*keep, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))

    return scored


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score below PASS."""
    return unpacked(fit(docs, labels)(packed(docs), "_row").where(F.col("score") < PASS), docs.columns)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scores = fit(docs, labels)(texts(docs), "doc_id")
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))
