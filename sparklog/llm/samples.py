"""Bounded samples of labelled documents, the only thing that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import held_out, texts

#: Most labelled rows that a classifier is fitted on.
SAMPLE_ROWS = 12_000


#: The parts in the order in which the rows of a label are dealt into them, so that a few rows reach all uses of parts.
PARTS = [0, 4, 8, 1, 5, 2, 6, 3, 7, 9]


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) outside the held-out fold; of an id labelled twice the largest label counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out())
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def shares(totals: dict[int, int], rows: int) -> dict[int, int]:
    """How many rows of each label are taken: half each, or what the other one leaves."""
    return {label: min(n, max(rows // 2, rows - totals.get(1 - label, 0))) for label, n in totals.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label, part, weight): texts of at most `rows` labelled ids outside the held-out fold.

    Both labels get their share of the sample, so a rare one is there whenever the table has it; `weight` is
    how many labelled ids of its label a row stands for. Of each label the ids with the smallest hashes are
    taken, and dealt into ten parts. Null labels and ids are left out; of an id with
    several texts the smallest counts. The ids are broadcast: they are at most `rows`.
    """
    known = usable_labels(labels, label)
    totals = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    chosen = None
    for kind, n in sorted(shares(totals, rows).items()):
        own = known.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        own = own.withColumn("weight", F.lit(totals[kind] / n))
        chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        chosen = known.limit(0).withColumn("weight", F.lit(1.0))
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit("part"), "doc_id"), "doc_id")) - 1
    part = F.get(F.array(*map(F.lit, PARTS)), turn % 10).cast("int").alias("part")
    named = chosen.select(F.col("doc_id").alias("_id"), "label", "weight", part)
    rows_ = texts(docs)
    met = rows_.join(F.broadcast(named), rows_["doc_id"] == named["_id"])
    return met.groupBy("doc_id", "label", "part", "weight").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "part", "weight")
