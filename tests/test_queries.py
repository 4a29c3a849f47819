"""Every registered query: against its SQL where it has one, else that it runs and returns rows."""

from __future__ import annotations

import pytest
from compare import compare, duck

from conftest import SMALL
from dispatchery.plans import load

LOADED = load()
SLOW = {"k1_duplicate_resolution", "a26_dedupe_stats", "t4_incremental_dedupe", "j9_fuzzy_join", "k4_publish_flow"}


@pytest.fixture(scope="module")
def connection(archive):
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(set(LOADED.queries) - SLOW))
def test_query(spark, archive, connection, name):
    problem, _ = compare(spark, connection, name, LOADED.queries[name], LOADED.oracles.get(name), SMALL)
    assert problem is None, problem


def test_every_check_belongs_to_a_query():
    assert set(LOADED.oracles) <= set(LOADED.queries)
