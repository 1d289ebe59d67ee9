"""Every signal query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from sampleloom.jobs import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


#: On the smallest tables these have no rows to compare.
SPARSE = {"j4_midi_delta_suspects"}


@pytest.mark.parametrize("name", sorted(SPARSE))
def test_same_rows_on_more(spark, name):
    larger = "/root/testdata/sf0.01"
    compare(registry.QUERIES[name](spark, larger), connect(larger), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SPARSE))
def test_same_rows(spark, sf, con, name):
    compare(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
