"""The registered queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparklog.llm import bpe, decontaminate, jaccard_join, license_scan, line_dedup, periodic_runs, pii, quality, secrets, simhash, token_alignment, token_counts, toxicity
from sparklog.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


@registered
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_likeness(table(spark, sf_dir, "documents"))


@registered
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@registered
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.listing(table(spark, sf_dir, "documents"))


@registered
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@registered
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@registered
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def byte_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@registered
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_vocabulary())


@registered
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return token_counts.token_counts(table(spark, sf_dir, "documents"), file.read())


@registered
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return token_alignment.alignment(table(spark, sf_dir, "documents"), a.read(), b.read())


@registered
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = periodic_runs.planted(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(changed))


ORACLES["op4_decontamination"] = decontaminate.ORACLE
ORACLES["op7_line_dedup"] = line_dedup.ORACLE
