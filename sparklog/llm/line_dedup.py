"""Removal of repeated lines by overlapping windows of three lines (DataFrame functions only).

Every three consecutive lines of a text are a window, known by two 64-bit hashes of its lines
without outer spaces. Of all windows with the same lines, in order of (doc_id, position) and
over all documents, the first one stays and every later one is removed; the windows that a
document loses are merged by the lines they cover. A text of fewer than three lines is one window.
Windows of blank lines only are left alone.

Rows with equal doc_id and text count as one document and share their result. A null text is
empty; null ids come last in the order. Every input row gives one output row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import packed, texts, unpacked

WINDOW = 3


def line_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, _pos, _h1, _h2) for each window of (doc_id, text)."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.split("text", "\n").alias("_lines"))
    count = F.size("_lines")
    shifted = [F.col("_lines"), *(F.slice("_lines", k + 1, count) for k in range(1, WINDOW))]
    windows = F.slice(F.arrays_zip(*shifted), F.lit(1), F.greatest(count - (WINDOW - 1), F.lit(1)))
    each = lines.select("doc_id", "_text", F.posexplode(windows).alias("_pos", "_window"))
    own = [F.trim(F.col("_window")[str(k) if k else "_lines"]) for k in range(WINDOW)]
    blank = F.length(F.concat_ws("", *own)) == 0
    return each.where(~blank).select(
        "doc_id", "_text", "_pos", F.xxhash64(*own).alias("_h1"), F.xxhash64(F.lit("second"), *own).alias("_h2")
    )


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, _starts): the windows each document loses; documents that lose none are left out."""
    windows = line_windows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_text", "_pos")
    repeated = (
        windows.groupBy(F.col("_h1").alias("_r1"), F.col("_h2").alias("_r2"))
        .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_times"))
        .where("_times > 1")
    )
    met = windows.join(repeated, (F.col("_h1") == F.col("_r1")) & (F.col("_h2") == F.col("_r2")))
    return met.where(~place.eqNullSafe(F.col("_first"))).groupBy("doc_id", "_text").agg(F.array_sort(F.collect_set("_pos")).alias("_starts"))


def _cut(rows: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, n_lines, n_removed, text): every text without its later windows."""
    lost = later_windows(rows).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"), "_starts")
    joined = rows.withColumn("_text", F.xxhash64("text")).join(
        lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left"
    )
    lines = joined.select("doc_id", *keep, "text", "_starts", F.split("text", "\n").alias("_lines"))
    # the stretches between one lost window's end and the next one's start
    before = F.concat(F.array(F.lit(-WINDOW)), F.col("_starts"))
    after = F.concat(F.col("_starts"), F.array(F.size("_lines")))
    kept = F.flatten(
        F.zip_with(before, after, lambda a, b: F.slice(F.col("_lines"), a + WINDOW + 1, F.greatest(b - a - WINDOW, F.lit(0))))
    )
    cut = lines.select(
        "doc_id", *keep, "text", F.size("_lines").cast("long").alias("n_lines"), F.when(F.col("_starts").isNotNull(), kept).alias("_kept")
    )
    return cut.select(
        "doc_id",
        *keep,
        "n_lines",
        F.coalesce(F.col("n_lines") - F.size("_kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("_kept", "\n"), F.col("text")).alias("text"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): every text without its later windows."""
    return _cut(texts(docs))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, their texts without later windows, and n_chars anew.

    A document that loses all it has is left out. A text that loses nothing stays as it is, null included.
    """
    rows = packed(docs)
    slim = rows.select("doc_id", "text", rows["_row"].dropFields("text").alias("_row"), F.col("_row.text").isNull().alias("_null"))
    cut = _cut(slim, "_row", "_null").where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return unpacked(cut.withColumn("text", F.when(~F.col("_null"), F.col("text"))), docs.columns, "text")


ORACLE = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 1))) AS pos FROM split),
windows AS (SELECT doc_id, pos, list_transform(lines[pos + 1 : pos + 3], lambda x: trim(x, ' ')) AS body FROM places),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS nth
  FROM windows WHERE array_to_string(body, '') <> ''),
covered AS (SELECT DISTINCT doc_id, pos + k.k AS line FROM ranked, (SELECT unnest(range(3)) AS k) k WHERE nth > 1),
numbered AS (SELECT doc_id, unnest(lines) AS body, unnest(range(len(lines))) AS line FROM split),
joined AS (
  SELECT n.doc_id, n.body, n.line, c.line IS NULL AS kept
  FROM numbered n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.line = c.line)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT kept) AS BIGINT) AS n_removed,
  coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (kept), '') AS text
FROM joined GROUP BY doc_id
"""
