"""Every registered query against its SQL on the smallest shared tables."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect, contract

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_agrees_with_sql(spark, database, name):
    assert compare(spark, database, name, SF_DIR) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
