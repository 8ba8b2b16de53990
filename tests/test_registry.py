"""Registered queries against their SQL on the smallest tables.  All of them
run with CHAINFRAME_ALL=1; otherwise one of each kind."""

import os

import pytest

import __spark_entry__ as registry
from chainframe.catalog.compare import differences, duck

SF = "/root/testdata/sf0.001"
SOME = [
    "template_a2", "template_f2", "template_c4", "template_ha4", "quantifier_nested", "pair_split_predicate",
    "densified_positions", "run_counts", "score_answers", "metrics_by_level", "extract_program", "vote_region",
    "compose_splits", "hard_negative_threshold_flip", "run_program_texts", "category_marginals", "chain_bands",
]
NAMES = sorted(registry.oracle_sql()) if os.environ.get("CHAINFRAME_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
