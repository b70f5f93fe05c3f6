from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of the smallest test table, by id."""
    return {row.doc_id: row.text for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words int, sig long, spans string, label int, `_starts` string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns named like results."""
    passage = " ".join(f"passage{i}" for i in range(60))
    texts = [
        (0, None),
        (1, ""),
        (2, " \n\t\n "),
        (3, "one"),
        (4, "alpha beta gamma delta epsilon zeta eta theta. All rights reserved."),
        (4, "alpha beta gamma delta epsilon zeta eta theta. All rights reserved."),
        (5, "Alpha beta\ngamma delta\nepsilon zeta eta theta. All rights reserved."),
        (6, "long " * 4000 + "x" * 5000 + " mail me.now@example.com or +1 (555) 123-4567, 10.0.0.1, token = \"0641917ea4e9feb9cda83477b57ac2654884f485\""),
        (7, passage + "\nline two\nline three\nline four"),
        (8, passage + "\nline two\nline three\nline five"),
        (None, passage + "\nline two\nline three\nline four"),
        (None, None),
        (9, "Émile     ünïcode \U0001f600 \x00 end\r\nnext"),
        (10, "idiot idiot you are STUPID!!! " * 20),
        (11, "Licensed under CC BY-NC 4.0. GNU General Public License version 3. cc by cc by"),
    ]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "src", None, 0.5, 1, 2, "x", 1, "y") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (None, 1, 1), (10, 0, 1), (10, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, " ".join(f"passage{i}" for i in range(20, 35))), (2, "Alpha, BETA"), (3, None), (None, "line two"), (2, "")]
    return spark.createDataFrame(rows, "item_id long, text string")
