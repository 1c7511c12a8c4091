"""Every registered query against its SQL twin (smallest tables; use tests.compare for more)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from siltmark.plans.catalog import ORACLES, QUERIES
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, small_dir, small_duck, name):
    note = difference(QUERIES[name](spark, small_dir), small_duck, ORACLES[name])
    assert note in (None, "both empty"), note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).collect()


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).count() == 4
