"""What has a row for each position or more goes around the driver, however small Spark takes the file to be."""

import re

import pytest

from __spark_entry__ import SMALLEST, queries
from chainframe.operators import pairs
from chainframe.sources.bindings import event_chains


def joins(df):
    """The joins of the plan, as they are before any stage has run."""
    return re.findall(r"(\w+Join) (.*)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["contact_edges", "neighbors_stored_radius"])
def test_positions_and_cubes_are_not_broadcast(spark, name):
    found = joins(queries()[name](spark, SMALLEST))
    assert found and {kind for kind, _ in found} == {"SortMergeJoin"}


def test_two_subsets_are_not_broadcast(spark):
    ev = event_chains(spark, SMALLEST)
    near = pairs.close_between(ev.where("ss = 'H'"), ev.where("ss = 'E'"), 8.0)
    assert {kind for kind, _ in joins(near)} == {"SortMergeJoin"}


@pytest.mark.parametrize("name, key", [("template_f2", "start#"), ("contact_density_nested", "seg#")])
def test_windows_and_segments_are_not_broadcast(spark, name, key):
    found = [kind for kind, keys in joins(queries()[name](spark, SMALLEST)) if key in keys.split("]")[0]]
    assert found and set(found) == {"SortMergeJoin"}
