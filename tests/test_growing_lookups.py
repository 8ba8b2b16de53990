"""What has a row for each position, or for each level of a chain, is not sent through the driver; texts are taken apart once."""

import re

import pytest

from __spark_entry__ import SMALLEST, queries
from chainframe.catalog import flows
from chainframe.plans import evaluate, programs
from chainframe.sources.bindings import event_chains


def plan(df):
    """As it is before any stage has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def joins_with(df, keys):
    found = re.findall(r"(\w+Join) \[species#\d+, uniprot#\d+, ([^\]]*)\]", plan(df))
    return [kind for kind, rest in found if re.search(keys, rest)]


@pytest.mark.parametrize("name", ["template_b1", "template_b2", "template_ha1"])
def test_lookup_of_a_position(spark, name):
    kinds = joins_with(queries()[name](spark, SMALLEST), r"_at#")
    assert kinds and set(kinds) == {"SortMergeJoin"}


@pytest.mark.parametrize("name, level", [
    ("template_b4", "threshold#"), ("template_ha4", "(threshold|plddt_thr)#"), ("template_ha5", "plddt_thr#"), ("template_f2", r"^w#\d+L?$"),
    ("template_hb4_program", "(threshold|plddt_thr)#"), ("template_hb5_program", "plddt_thr#"), ("template_g2", "plddt_thr#")])
def test_values_per_level_are_merged_also_at_run_time(spark, name, level):
    """The adaptive plan counts a chain's levels as one row, so it has to be the hint that decides."""
    df = queries()[name](spark, SMALLEST)
    df.collect()
    kinds = joins_with(df, level)
    assert kinds and set(kinds) == {"SortMergeJoin"}


def test_text_without_reasoning_is_made_once(spark):
    rows = spark.createDataFrame([("q", "Int", "n_helices()")], "qid string, answer_type string, text string")
    made = evaluate.parsed_responses(rows)._jdf.queryExecution().optimizedPlan().toString()
    # Once for the body, once for the search of a program in it.
    assert made.count("<think>") == 2


def test_programs_are_matched_once(spark):
    texts = spark.createDataFrame([("q", "human", "U0", "n_helices()")], "qid string, species string, uniprot string, program string")
    ran = programs.run_programs(texts, flows._chain_set(spark, SMALLEST), ["A4", "B1", "E6"])
    # The shapes are looked up in a map that names them all.
    assert "radius_of_gyration" not in plan(ran) and "n_helices" not in plan(ran)


def test_positions_of_the_gold_answers_are_numbered_once(spark, monkeypatch):
    numbered = []

    def counted(*args):
        numbered.append(args)
        return event_chains(*args)

    monkeypatch.setattr(flows, "event_chains", counted)
    got = queries()["evaluate_responses"](spark, SMALLEST)
    assert len(numbered) == 1 and "_piece#" not in plan(got)
