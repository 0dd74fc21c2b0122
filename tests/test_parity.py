"""Every registered query against its DuckDB text."""

from __future__ import annotations

import pytest
from parity import compare, connect

from paceline.plans.catalogue import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle_connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees(name, spark, oracle_connection):
    assert name in ORACLES
    difference = compare(QUERIES[name](spark, SF_DIR), oracle_connection, ORACLES[name])
    assert difference is None, difference
