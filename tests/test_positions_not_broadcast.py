"""No plan over contacts sends a row per position, cube, window or segment through the driver, whatever Spark guesses
from a small file."""

import re

import pytest

from __spark_entry__ import SMALLEST, queries

PLANS = [
    "long_range_contacts", "neighbors_stored_radius", "template_b4", "template_d4", "template_d5", "template_f1", "template_f2",
    "template_g2", "template_g3", "template_ha4", "template_ha5", "template_hb4_program", "contact_density_nested",
    "region_mean_neighbors", "template_hb5_program",
]
#: Keys of joins whose two sides grow with the positions.
GROWING = r"\[species#.*(_cx#|_piece#|start#|seg#)"


@pytest.mark.parametrize("name", PLANS)
def test_growing_sides_meet_in_merge_joins(spark, name):
    plan = queries()[name](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    found = [kind for kind, keys in re.findall(r"(\w+Join) (.*)", plan) if re.match(GROWING, keys.split("]")[0])]
    assert found and set(found) == {"SortMergeJoin"}
