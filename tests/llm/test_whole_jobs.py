"""Inputs on which a shortened job gives other results."""

from __future__ import annotations

import random
import re
from re import _parser as parser

from sparklog.llm import jaccard_join, license_rules, license_scan, pii
from tests.llm.test_methods import groups, shingles


def test_jaccard_join_of_copies_with_a_shared_passage(spark, monkeypatch):
    """Each text has a copy with a passage added that five copies hold, too few for frequent tokens, enough for a large group."""
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", 24)
    monkeypatch.setattr(jaccard_join, "PIVOT_SIZE", 3)
    draw = random.Random(7)
    docs = {}
    for number in range(40):
        passage = " ".join(f"passage{number // 5}of{k}" for k in range(19))
        text = " ".join(f"w{draw.randrange(10**6)}" for _ in range(84))
        docs |= {2 * number: text, 2 * number + 1: f"{text} {passage}"}
    rows = jaccard_join.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    expected = groups({i: shingles(t) for i, t in docs.items()})
    assert len(set(expected.values())) == 40
    assert {r.doc_id: r.component_id for r in rows} == expected


def test_terms_of_unique_entities_and_far_words(spark):
    """Every address is unique; its domain's employer stands far off, and twice; copies of one text prove nothing."""
    filler = "the and of here is a plain text with common words that say nothing at all"
    rows = [(i, f"Acmeworks {filler} user{i}@acme.example.com {filler} again Acmeworks own{i}") for i in range(12)]
    rows += [(i, f"{filler} again number{i} plain") for i in range(20, 320)]
    rows += [(i, f"{filler} again copied lonely@else.example.org") for i in range(400, 405)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        marked = [text[s.start : s.end] for s in found[i].added]
        assert marked == (["Acmeworks"] * 2 if i < 12 else []), (i, marked)
    text = rows[0][1]
    generalised = pii.replaced(text, [{"kind": "generalise", "start": 0, "end": 9}])
    assert generalised.startswith("[NAME] the and")


def spelled(parts, longest):
    """Texts that a rule's pattern matches: one for each alternative, options left out or all taken."""
    found = [""]
    for op, value in parts:
        if op is parser.LITERAL:
            own = [chr(value)]
        elif op is parser.IN:
            own = [chr(v if kind is parser.LITERAL else v[0]) for kind, v in value]
        elif op is parser.MAX_REPEAT:
            least, most, inner = value
            own = [text * (most if longest else least) for text in spelled(inner, longest)]
        elif op is parser.SUBPATTERN:
            own = spelled(value[-1], longest)
        else:
            assert op is parser.BRANCH, op
            own = [text for branch in value[1] for text in spelled(branch, longest)]
        found = [a + b for a in found for b in own]
    return found


def test_every_license_rule_passes_its_prefilter():
    rules = license_rules.all_rules()
    gate = {r.keyword.split()[0] for r in rules} | {phrase.split()[0] for phrase, _ in license_scan.PHRASES}
    for rule in rules:
        for text in {t for longest in (False, True) for t in spelled(parser.parse(rule.pattern), longest)}:
            assert re.fullmatch(rule.pattern, text) and rule.keyword in text, (rule, text)
            assert rule.keyword.split()[0] in text.split() and gate & set(text.split()), (rule, text)


def test_short_license_names(spark):
    texts = {"GPLv2": "gpl-2", "under GPLv3+": "gpl-3", "LGPLv2.1": "lgpl-2.1", "AGPL-3.0": "agpl-3.0", "MPL 2.0": "mpl-2.0", "the EPL": "epl", "CDDL v1.1": "cddl-1.1", "EUPL": "eupl"}
    texts |= {"zlib/libpng License": "zlib", "PHP 3.01": "php-3.01", "PHP licence": "php", "FreeBSD license": "bsd-2-clause", "GPL3": "gpl-3", "nothing here": ""}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in license_scan.scan(frame).collect()}
    assert {t: found[i] for i, t in enumerate(texts)} == texts
