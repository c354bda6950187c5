"""Every query with an oracle against DuckDB, and the rest for rows, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle
from wayfarer import catalog

QUERIES, SQL = catalog.queries(), catalog.oracles()  # tests/llm has its own
# model queries whose fits take long; tests/test_learning.py covers them on small fixtures
SLOW = {"model_bakeoff", "grid_search", "fold_scores", "multi_output", "feature_set_ranking", "kmeans_sweep", "mlp", "linear_svm", "tuning_neighbours"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, sf_dir, duck, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
