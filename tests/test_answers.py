"""Scoring, extraction and voting."""

import random

import pytest
from pyspark.sql import functions as F

from chainframe.functions import scalars, scoring, text
from chainframe.plans import evaluate, voting

SCORES = [
    ("true", "Bool", "yes", True), ("true", "Bool", "No, it is not", False), ("true", "Bool", "perhaps", False),
    ("50", "Int", "51", True), ("50", "Int", "53", True), ("50", "Int", "60", False), ("0", "Int", "2", True), ("0", "Int", "3", False),
    ("8.3", "Float", "8.4", True), ("8.3", "Float", "8.7", True), ("8.3", "Float", "12.0", False), ("8.3", "Float", "none", False),
    ("[100, 130]", "Region", "residues 100 to 130", True), ("[100, 130]", "Region", "[101, 130]", False),
    ("H", "SecStruct", "helix", True), ("H", "SecStruct", "strand", False), ("H", "SecStruct", "α-helix.", True),
    ("[]", "ResidueSet", "[]", True), ("[]", "ResidueSet", "[1]", False),
    (str(list(range(1, 10))), "ResidueSet", str(list(range(1, 11))), True),
    (str(list(range(1, 10))), "ResidueSet", str(list(range(1, 9))), False),
    (str([[i, i + 20] for i in range(9)]), "PairSet", str([[i, i + 20] for i in range(10)]), True),
    (str([[i, i + 20] for i in range(9)]), "PairSet", str([[i, i + 20] for i in range(5)]), False),
    ("A", "AAType", " a", True), ("x", "Other", "x ", True),
    ("Unreliable", "Float|Unreliable", "unreliable", True), ("Unreliable", "Float|Unreliable", "8.5", False),
    ("8.5", "Float|Unreliable", "I cannot determine it", False), ("8.5", "Float|Unreliable", "8.4", True),
]


def test_score_table(spark):
    df = spark.createDataFrame([(k, *s) for k, s in enumerate(SCORES)], "k int, gold string, kind string, pred string, want boolean")
    bad = df.withColumn("s", scoring.score(F.col("gold"), F.col("kind"), F.col("pred"))).where("s.correct != want").collect()
    assert not bad


def test_failure_modes_and_metrics(spark):
    kind = "Float|Unreliable"
    rows = [("a", kind, "Unreliable", "unreliable"), ("b", kind, "Unreliable", "8.5"), ("c", kind, "8.5", "unreliable"), ("d", kind, "8.5", "8.4")]
    df = spark.createDataFrame([(*r, "Ha", "Ha1") for r in rows], "qid string, answer_type string, gold_answer string, pred_answer string, family string, template string")
    scored = evaluate.evaluate(df.drop("pred_answer"), df.select("qid", "pred_answer"))
    modes = {r["qid"]: r["failure_mode"] for r in scored.collect()}
    assert modes == {"a": None, "b": "over_confident", "c": "over_abstention", "d": None}
    m = evaluate.metrics(scored).where("level = 'overall'").first()
    assert (m["abstention_recall"], m["accuracy_when_value"], m["over_confident_rate"], m["over_abstention_rate"]) == (0.5, 0.5, 0.25, 0.25)


PROGRAMS = [
    ("mean_plddt(range(50, 100))", "mean_plddt(range(50, 100))"),
    ("```\nmean_plddt(range(1, 9));\n```", "mean_plddt(range(1, 9))"),
    ("```json\n{\"program\": \"n_helices()\"}\n```", "n_helices()"),
    ("use `distance(residue(1), residue(2))` now", "distance(residue(1), residue(2))"),
    ('{"query": "n_strands()"}', "n_strands()"),
    ("The program is: see\nProgram: 'size(filter r in all_residues where ss(r) == \"H\")';", 'size(filter r in all_residues where ss(r) == "H")'),
    ("<think>maybe n_helices()</think>then\nss(residue(4))", "ss(residue(4))"),
    ("hello\n  if plddt(residue(1)) < 50 then \"Unreliable\" else 3 \nbye", 'if plddt(residue(1)) < 50 then "Unreliable" else 3'),
    ("nothing to see (here)", None), ("", None),
]


def test_extract_program(spark):
    df = spark.createDataFrame(PROGRAMS, "t string, want string")
    bad = df.withColumn("got", text.extract_program(F.col("t"))).where("not (got <=> want)").collect()
    assert not bad


RESPONSES = [
    ("Yes, the protein has a helix.", "Bool", None, "true", False), ("It does not contain any.", "Bool", None, "false", False),
    ("it is absent", "Bool", None, "false", False),
    ("around 42 residues", "Int", None, "42", False), ("-3.5e2 units", "Float", None, "-3.5e2", False),
    ("from 120-149", "Region", None, "[120, -149]", False), ("see [3, 9]", "Region", None, "[3, 9]", False),
    ("120 through 149", "Region", None, "[120, 149]", False), ("a beta-strand", "SecStruct", None, "E", False),
    ("the list [1, 4, 7]", "ResidueSet", None, "[1, 4, 7]", False),
    ("I am uncertain", "Float|Unreliable", None, "Unreliable", True),
    ("tool distance(1) <answer> 7 </answer>", "Int", None, "7", False),
    ("n_helices()", "Int", "n_helices()", None, False), ("no idea", "Region", None, None, False),
]


def test_parse_responses(spark):
    df = spark.createDataFrame(RESPONSES, "text string, answer_type string, program0 string, scalar0 string, abstained0 boolean")
    got = evaluate.parsed_responses(df).collect()
    for r in got:
        want = r["scalar0"]
        if r["text"] == "from 120-149":
            want = "[120, 149]"  # the dash is a range here
        assert (r["program"], r["scalar"], r["abstained"]) == (r["program0"], want, r["abstained0"]), r


def test_tool_call(spark):
    df = spark.createDataFrame([("tool_dsl(count r in (a) where (b) ) tail)",), ("no call",), ("f(open",)], "t string")
    got = [r["c"] for r in df.select(text.tool_call(F.col("t")).alias("c")).collect()]
    assert (got[0]["name"], got[0]["payload"]) == ("tool_dsl", "count r in (a) where (b) ") and got[1] is None and got[2] is None


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_round_is_half_even_on_the_binary_value(spark, digits):
    values = [2.675, 0.125, 2.5, 3.5, -2.5, 1.005, 0.35, 1e-9, 123456.785]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(scalars.py_round(F.col("v"), digits)).collect()] == [round(v, digits) for v in values]


def test_answers_differ(spark):
    rows = [("Float", "1.0", "1.5", True), ("Float", "100.0", "100.5", False), ("Float", "100.0", "108.0", True), ("Int", "10", "12", True),
            ("Int", "100", "102", False), ("Int", "100", "103", True), ("Bool", "true", "false", True), ("Region", "[1, 2]", "[1, 3]", True),
            ("Float|Unreliable", "Unreliable", "3.0", True), ("ResidueSet", "[1, 2]", "[2, 1]", False), ("SecStruct", "H", "H", False)]
    df = spark.createDataFrame(rows, "kind string, a string, b string, want boolean")
    assert df.where(scoring.answers_differ(F.col("a"), F.col("b"), F.col("kind")) != F.col("want")).collect() == []


def _iou(a, b):
    inter = max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1)
    union = (a[1] - a[0] + 1) + (b[1] - b[0] + 1) - inter
    return inter / union if union > 0 else 0.0


def _jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def _medoid(values, overlap):
    best, at = -1.0, 0
    for i, v in enumerate(values):
        score = sum(overlap(v, w) for j, w in enumerate(values) if j != i) / max(1, len(values) - 1)
        if round(score, 12) > round(best, 12):
            best, at = score, i
    return at, best


def test_votes_against_direct_rules(spark):
    rng = random.Random(3)
    samples, regions, sets = [], {}, {}
    for q in range(60):
        n = rng.randint(1, 6)
        regions[q] = [(s, s + rng.choice([-1, 4, 9])) for s in (rng.randint(1, 12) for _ in range(n))]
        sets[q] = [frozenset(rng.sample(range(5), rng.randint(0, 3))) for _ in range(n)]
        samples += [(q, k) for k in range(n)]
    reg = spark.createDataFrame([(q, k, *v) for q, vs in regions.items() for k, v in enumerate(vs)], "qid long, idx int, start long, end long")
    for r in voting.region_vote(reg).collect():
        at, score = _medoid(regions[r["qid"]], _iou)
        assert (r["start"], r["end"]) == regions[r["qid"]][at] and abs(r["agreement"] - score) < 1e-9
    mem = spark.createDataFrame([(q, k, i) for q, vs in sets.items() for k, v in enumerate(vs) for i in v], "qid long, idx int, i long")
    all_ = spark.createDataFrame(samples, "qid long, idx int")
    seen = 0
    for r in voting.set_vote(mem, all_).collect():
        at, score = _medoid(sets[r["qid"]], _jaccard)
        assert r["idx"] == at and abs(r["agreement"] - score) < 1e-9
        seen += 1
    assert seen == 60


def test_bool_tie_and_mode_tie(spark):
    df = spark.createDataFrame([(1, 0, True, "b"), (1, 1, False, "a"), (2, 0, False, "x"), (2, 1, False, "x"), (2, 2, True, "y")], "qid long, idx int, v boolean, s string")
    got = {r["qid"]: (r["answer"], r["agreement"]) for r in voting.bool_vote(df, "v").collect()}
    assert got[1] == (True, 0.5) and got[2][0] is False
    mode = {r["qid"]: r["answer"] for r in voting.mode_vote(df, "s").collect()}
    assert mode == {1: "b", 2: "x"}


def test_consensus_dispatch(spark):
    rows = [("a", k, "Int", v) for k, v in enumerate(["3", "4", "4", "true"])] + [("b", k, "Float", v) for k, v in enumerate(["1.0", "9.5", "2.5"])]
    rows += [("c", 0, "Region", "[1, 5]"), ("d", 0, "ResidueSet", "[1, 2]"), ("d", 1, "ResidueSet", "[1, 2]"), ("e", 0, "Bool", None), ("f", 0, "Bool|Unreliable", "Unreliable")]
    df = spark.createDataFrame(rows, "qid string, idx int, answer_type string, value string")
    got = {r["qid"]: r["answer"] for r in voting.consensus(df).collect()}
    assert got == {"a": "4", "b": "2.5", "c": "[1, 5]", "d": "[1, 2]", "e": None, "f": "Unreliable"}


def test_two_sided_binomial():
    import math
    for k, n in [(0, 0), (0, 5), (3, 9), (40, 100), (4990, 10000)]:
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, j) for j in range(k + 1)) / 2**n)
        assert abs(evaluate._two_sided(k, n) - want) < 1e-9
    assert evaluate._two_sided(499_000_000, 1_000_000_000) == 0.0


def test_bootstrap_interval_covers_the_mean(spark):
    df = spark.range(2000).select(F.lit("c").alias("cell"), (F.col("id") % 4 == 0).alias("correct"))
    r = evaluate.bootstrap(df, ["cell"]).first()
    assert r["n"] == 2000 and r["ci_low"] < 0.25 < r["ci_high"] and r["ci_high"] - r["ci_low"] < 0.06
