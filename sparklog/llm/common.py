"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.session import scratch_path, shuffles_removed

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) and nothing else, a null text as an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row): `_row` holds all columns, so that no name of theirs can clash with a step's own."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row)


def unpacked(rows: DataFrame, names: list[str], text: str | None = None) -> DataFrame:
    """The columns in `_row`; with `text`, that column instead of the text, and its length as n_chars."""
    changed = {"text": F.col(text), "n_chars": F.length(text).cast("long")} if text else {}
    return rows.select(*[changed.get(name, F.col("_row")[name]).alias(name) for name in names])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read again: later steps start from the files."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out() -> Column:
    """Whether a document belongs to the fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
