"""Examples from several families: who gets them, in which order, and that a target works out its turns alone."""

from chainframe.plans import prompts


def questions(spark, sizes):
    rows = [(f"{f}{t}-{k}", f, f"{f}{t}") for f, t, count in sizes for k in range(count)]
    return rows, spark.createDataFrame(rows, "qid string, family string, template string")


def test_turns_of_families(spark):
    rows, train = questions(spark, [("A", 0, 1), ("A", 1, 1), ("B", 0, 4), ("C", 0, 2), ("C", 1, 3)])
    _, targets = questions(spark, [("A", 0, 2), ("B", 0, 2), ("C", 1, 2), ("D", 0, 2)])
    of = {q: (f, t) for q, f, t in rows}
    got = {}
    for r in prompts.pick_across_families(train, targets, 5).collect():
        got.setdefault(r["target"], {})[r["place"]] = of[r["exemplar"]] + (r["exemplar"],)
    want = {"A0": "ABCBC", "B0": "ACACC", "C1": "ABCAB", "D0": "ABCAB"}
    assert len(got) == 8
    for target, places in got.items():
        own = target.split("-")[0]
        turns = [places[k] for k in sorted(places)]
        assert "".join(f for f, _, _ in turns) == want[own]
        assert all(t != own for _, t, _ in turns) and len({q for _, _, q in turns}) == 5


def test_turns_stay_in_their_row(spark):
    _, train = questions(spark, [("A", 0, 3), ("B", 0, 3)])
    _, targets = questions(spark, [("A", 0, 2)])
    plan = prompts.pick_across_families(train, targets, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window [row_number" in line and "[target#" in line]
