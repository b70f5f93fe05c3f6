"""Every operator over awkward rows and empty tables: one defined result for each row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparklog.llm import bpe, decontaminate, jaccard_join, license_scan, line_dedup, pii, quality, secrets, simhash, toxicity
from sparklog.llm.queries import byte_vocabulary

OPERATORS = {
    "jaccard": lambda docs, labels, benchmark: jaccard_join.near_duplicates(docs),
    "pii": lambda docs, labels, benchmark: pii.listing(docs),
    "sanitise": lambda docs, labels, benchmark: pii.sanitise(docs),
    "secrets": lambda docs, labels, benchmark: secrets.scan(docs),
    "decontaminate": lambda docs, labels, benchmark: decontaminate.contamination(docs, benchmark),
    "toxicity": lambda docs, labels, benchmark: toxicity.score(docs, labels),
    "lines": lambda docs, labels, benchmark: line_dedup.dedup_lines(docs),
    "licenses": lambda docs, labels, benchmark: license_scan.scan(docs),
    "bpe": lambda docs, labels, benchmark: bpe.round_trip(docs, byte_vocabulary()),
    "quality": lambda docs, labels, benchmark: quality.score(docs, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, awkward, nothing, labels, benchmark):
    got = OPERATORS[name](awkward, labels, benchmark)
    assert sorted(got.select("doc_id").collect(), key=str) == sorted(awkward.select("doc_id").collect(), key=str)
    assert OPERATORS[name](nothing, labels.limit(0), benchmark.limit(0)).count() == 0


def test_simhash_keeps_repeated_rows(spark, awkward, nothing):
    rows = simhash.edited_likeness(awkward).collect()
    assert len(rows) == 15 and simhash.edited_likeness(nothing).count() == 0
    assert len([r for r in rows if r.doc_id == 4]) == 2
    copies = spark.createDataFrame([(100, "a b c")] * 3 + [(101, "a b c"), (102, ""), (102, "")], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_within) for r in simhash.edited_likeness(copies).collect())
    assert found == [(100, 4)] * 3 + [(101, None), (102, None), (102, None)]
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1].fingerprint == "0" * 16 == by_id[2].fingerprint and by_id[0].near_next is not None
    assert all(r.near_next is None for r in rows if r.doc_id is None)


@pytest.mark.parametrize(
    "stage",
    [
        lambda docs, labels, benchmark: toxicity.clean(docs, labels),
        lambda docs, labels, benchmark: line_dedup.without_repeats(docs),
        lambda docs, labels, benchmark: jaccard_join.one_of_each(docs),
        lambda docs, labels, benchmark: decontaminate.uncontaminated(docs, benchmark),
    ],
)
def test_stages_keep_all_columns(stage, awkward, nothing, labels, benchmark):
    got = stage(awkward, labels, benchmark)
    assert got.columns == awkward.columns and 0 < got.count() <= awkward.count()
    assert stage(nothing, labels, benchmark).count() == 0
    assert got.where("doc_id = 3").select("text", "score", "label").collect() == [("one", 0.5, 1)]


def test_near_copies_and_repeated_lines(awkward):
    found = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.near_duplicates(awkward).collect()}
    assert found[(5, 7)] == 4 and found[(8, 62)] == 7 and found[(None, 62)] == 7 and found[(None, 0)] is None
    cut = {r.doc_id: r.text for r in line_dedup.dedup_lines(awkward).where("doc_id IN (7, 8)").collect()}
    assert cut[7].startswith("passage0") and cut[8] == "line five"


def test_hits_are_merged(awkward, benchmark):
    rows = decontaminate.contamination(awkward, benchmark).where("doc_id IN (7, 5)").orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows] == [(11, 2, 1, True), (66, 17, 2, True)]
    cut = decontaminate.search(awkward, benchmark, with_text=True).where("doc_id = 5").first()
    assert cut.cut == "\ngamma delta\nepsilon zeta eta theta. All rights reserved."


def test_blocks_of_the_benchmark_add_up(awkward, benchmark, monkeypatch):
    whole = decontaminate.contamination(awkward, benchmark).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    assert sorted(decontaminate.contamination(awkward, benchmark).collect(), key=str) == sorted(whole, key=str)


def test_sanitised_text(awkward):
    text = pii.sanitise(awkward).where("doc_id = 6").first().text
    assert "[EMAIL]" in text and "[PHONE]" in text and "[IP]" in text and "example.com" not in text


def test_terms_that_disclose_an_entity(spark):
    """A rare word beside one address in several texts is removed; common words stay."""
    rows = [(i, f"the quick zanzibar of bob@mail.example.com and text number{i} is here") for i in range(4)]
    rows += [(i, f"the and of here is text quick another{i}") for i in range(10, 40)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first()
    text = rows[0][1]
    assert {text[s.start : s.end] for s in found.added if s.kind == "remove"} == {"zanzibar"}
    assert [s.kind for s in found.base] == ["email"]


def test_secrets_found(awkward):
    row = secrets.scan(awkward).where("doc_id = 6").first()
    assert row.n_candidates >= 1 and row.n_secrets == 1
    assert awkward.where(F.col("n_chars").isNotNull()).count() == 0
