"""Quality scores by Bradley-Terry ranking of document pairs.

Each document has a row of text statistics. From a bounded sample of labelled documents come
pairs of a preferred (label 1) and a rejected one (label 0); the weights minimise the logistic
loss on the difference of their features, which is the Bradley-Terry likelihood. A document's
score is its weighted sum, and it passes above a quantile of the scores of all documents: that of the share of
rejected ones among all usable labels. The reported score maps that threshold to PASS, in a logistic curve.

An empty or null text is a row of zeros and gets a score like any other. Rows are independent,
so repeated rows and null ids keep one result each. Without labels of both kinds every score is
the share of label 1, or 0 without any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import held_out, stored, texts
from sparklog.llm.samples import labelled_sample, usable_labels

PASS = 0.3
PAIRS_A_ROW = 8
#: The threshold's rank is right to one in so many documents.
QUANTILE_ACCURACY = 10_000
STEPS = 400

_LETTERS, _UPPER, _DIGITS = re.compile(r"[^\W\d_]"), re.compile(r"[A-ZÀ-Þ]"), re.compile(r"[0-9]")
_SYMBOLS, _POINTS, _BANGS = re.compile(r"[^\w\s.,;:!?'\"()-]|_"), re.compile(r"[.,;:]"), re.compile(r"[!?]")
_SENTENCE = re.compile(r"[.!?]+")


def statistics(text: str) -> list[float]:
    """Numbers about the whole text: lengths, kinds of characters, and repetition."""
    words = text.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, chars = len(words), len(text)
    counts = Counter(words)
    top = counts.most_common(3)
    lines = text.split("\n")
    sentences = len(_SENTENCE.findall(text)) + 1
    rates = [len(p.findall(text)) / chars for p in (_LETTERS, _UPPER, _DIGITS, _SYMBOLS, _POINTS, _BANGS)]
    same_next = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    return [
        math.log(chars),
        *rates,
        *(math.log(rate + 1e-3) for rate in rates),
        len(counts) / n,
        math.log(len(counts)) / math.log(n + 1),
        top[0][1] / n,
        sum(k for _, k in top) / n,
        same_next,
        math.log(same_next + 1e-3),
        min(mean, 40.0),
        min(max(lengths), 200) / 10.0,
        math.log(n / sentences),
        math.log(n / len(lines)),
        len(set(lines)) / len(lines),
        sum(w.isupper() for w in words) / n,
        sum(w[0].isupper() for w in words) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        sum(k for k in counts.values() if k == 1) / n,
    ]


N_STATISTICS = 1 + 6 + 6 + 15


def expanded(rows: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised statistics, their squares and their parts above and below one deviation."""
    z = np.clip((rows - centre) / spread, -6, 6)
    return np.concatenate([z, z * z / 6, np.maximum(z - 1, 0), np.maximum(-1 - z, 0)], axis=1)


class Ranking:
    """Weights of the statistics, fitted on pairs; picklable, a few kilobytes."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.centre, self.spread = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
        good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        self.constant = None
        if not len(good) or not len(bad):
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return
        self.centre, self.spread = rows.mean(0), rows.std(0) + 1e-6
        x = expanded(rows, self.centre, self.spread)
        draw = np.random.default_rng(17)
        pairs = PAIRS_A_ROW * max(len(good), len(bad))
        difference = x[draw.choice(good, pairs)] - x[draw.choice(bad, pairs)]
        weights, first, second = (np.zeros(x.shape[1]) for _ in range(3))
        for step in range(1, STEPS + 1):  # Adam on the mean logistic loss
            wrong = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
            slope = -(wrong @ difference) / pairs + 1e-4 * weights
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
            weights = weights - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights = weights
        self.scale = float((x @ weights).std()) / 2 + 1e-9

    def worths(self, rows: np.ndarray) -> np.ndarray:
        """The weighted sums, in units of their spread."""
        return expanded(rows, self.centre, self.spread) @ self.weights / self.scale


def _batch_statistics(column: pa.Array) -> np.ndarray:
    return np.array([statistics(value.as_py()) for value in column], float).reshape(-1, N_STATISTICS)


def fit(docs: DataFrame, labels: DataFrame) -> Ranking:
    """The ranking learned from at most samples.SAMPLE_ROWS labelled documents."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _batch_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "label", "rows"])

    sample = labelled_sample(docs, labels, "quality").select("doc_id", "text", "label")
    found = sample.mapInArrow(measured, "doc_id long, label int, rows array<double>").toPandas().sort_values("doc_id", kind="stable")
    return Ranking(np.array(found["rows"].tolist(), float).reshape(-1, N_STATISTICS), found["label"].to_numpy(int))


def worths(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, worth) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.worths(_batch_statistics(batch.column(1))))], ["doc_id", "worth"])

    return texts(docs).mapInArrow(run, "doc_id long, worth double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels)
    if model.constant is not None:
        scores = texts(docs).select("doc_id", F.lit(model.constant).alias("score"))
    else:
        found = stored(worths(docs, model), "worths")
        rejected = usable_labels(labels, "quality").agg(F.avg(1 - F.col("label"))).first()[0]
        threshold = found.agg(F.percentile_approx("worth", rejected, QUANTILE_ACCURACY)).first()[0]
        place = F.greatest(F.least(F.col("worth") - F.lit(threshold) + math.log(PASS / (1 - PASS)), F.lit(30.0)), F.lit(-30.0))
        scores = found.select("doc_id", (1 / (1 + F.exp(-place))).alias("score"))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))
