"""Every registered query against its SQL counterpart in another engine (TEST_SF_DIR picks the scale)."""

import pytest

import __spark_entry__ as entry
from oracle_compare import compare, duck

from pavilion import registry
from pavilion.oracles import load as oracles

QUERIES = {name: entry.queries()[name] for name in registry.catalogue()}
ORACLES = oracles.statements()


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) in ("", "both empty")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
