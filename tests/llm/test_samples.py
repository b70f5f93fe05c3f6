"""Samples of labelled rows: both labels whenever the table has them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparklog.llm import quality, samples, toxicity


def frames(spark, n, rare):
    """n documents; `rare` of them toxic, with insults, and of low quality."""
    draw = random.Random(4)
    words = ["the", "river", "and", "stone", "house", "green", "walks", "slowly", "over", "bridge"]
    rows, marks = [], []
    for i in range(n):
        bad = i % (n // rare) == 1 and i // (n // rare) < rare
        text = " ".join(draw.choices(words, k=30))
        rows.append((i, text + (" you stupid idiot!!!" * 4 + " ### $$$ %%%" * 10 if bad else "")))
        marks.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_both_labels_are_sampled_and_weighed(spark):
    docs, labels = frames(spark, 1000, 20)
    known = {r.label: r["count"] for r in samples.usable_labels(labels, "toxic").groupBy("label").count().collect()}
    rows = samples.labelled_sample(docs, labels, "toxic", rows=100).collect()
    assert {label: sum(r.label == label for r in rows) for label in (0, 1)} == {1: known[1], 0: 100 - known[1]}
    for label in (0, 1):
        assert abs(sum(r.weight for r in rows if r.label == label) - known[label]) < 1e-6
        assert {r.part for r in rows if r.label == label} == set(range(10))
    assert samples.shares({0: 10, 1: 5}, 100) == {0: 10, 1: 5}
    assert samples.shares({0: 1000, 1: 1000}, 100) == {0: 50, 1: 50}


def test_few_toxic_labels_still_teach(spark):
    """400 labels, 3 of them toxic: no score is a constant, and the toxic ones are the highest."""
    docs, labels = frames(spark, 400, 3)
    rows = toxicity.score(docs, labels).collect()
    bad = {r.doc_id for r in labels.where("toxic = 1").collect()}
    low = max(r.score for r in rows if r.doc_id not in bad)
    assert len({r.score for r in rows}) > 1 and all(r.score > low for r in rows if r.doc_id in bad)
    assert {r.doc_id for r in rows if r.predicted} == bad
    assert toxicity.clean(docs, labels).count() == 400 - len(bad)


def test_threshold_is_a_quantile_of_all_documents(spark):
    """Labels lean to good documents; the share that is rejected is that of the labels, among all documents."""
    docs, labels = frames(spark, 600, 60)
    rows = quality.score(docs, labels.where(F.col("doc_id") < 300)).collect()
    share = samples.usable_labels(labels.where(F.col("doc_id") < 300), "quality").agg(F.avg(1 - F.col("label"))).first()[0]
    rejected = sum(r.predicted == 0 for r in rows) / len(rows)
    assert abs(rejected - share) < 0.01
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert max(r.score for r in rows if r.doc_id in bad) < min(r.score for r in rows if r.doc_id not in bad)
