"""Template plans against direct computation; program texts round trip."""

import pytest
from pyspark.sql import functions as F

from chainframe.plans import generate, programs
from chainframe.plans.templates import TEMPLATES, ChainSet, answer_template, questions_for

pytestmark = pytest.mark.usefixtures("small_blocks")


@pytest.fixture(scope="module")
def sets(residues, pae_rows):
    return ChainSet(residues, pae_rows)


def run(name, sets, gold=True):
    q = questions_for(name, sets.chains(), 3)
    asked = {r["qid"]: (r["uniprot"], r["params"]) for r in q.collect()}
    return asked, answer_template(name, q, sets, gold).collect()


@pytest.fixture(scope="module")
def named(chains):
    return {c.name: c for c in chains}


def test_sets_of_pairs(sets, named, monkeypatch):
    asked, rows = run("B3", sets)
    got = {}
    for r in rows:
        got.setdefault(r["qid"], set()).add((r["i"], r["j"]))
    assert asked
    for qid, (name, p) in asked.items():
        c = named[name]
        want = {(i, j) for i, j in c.pairs(20) if j - i >= p["sep"] and c.dist(i, j) < p["threshold"]}
        assert got.get(qid, set()) == want


def test_sets_of_residues(sets, named):
    asked, rows = run("G1", sets)
    got = {}
    for r in rows:
        got.setdefault(r["qid"], set()).add(r["i"])
    for qid, (name, p) in asked.items():
        c = named[name]
        want = {i + 1 for i in range(c.n) if float(c.rel[i]) < p["sasa_thr"] and c.plddt[i] < p["plddt_thr"]}
        assert got.get(qid, set()) == want


@pytest.mark.parametrize("name", ["Ha4", "Hb4"])
def test_gold_and_program_rules_differ(sets, named, name):
    asked, rows = run(name, sets, gold=name == "Ha4")
    got = {r["qid"]: r for r in rows}
    for qid, (uniprot, p) in asked.items():
        c = named[uniprot]
        if (c.plddt < p["plddt_thr"]).sum() * 100 / c.n > p["coverage_thr"]:
            assert got[qid]["s"] == "Unreliable" and got[qid]["n"] is None
            continue
        if name == "Ha4":
            want = sum(j - i > p["sep"] for i, j in c.pairs(p["threshold"]))
        else:
            want = sum(j - i >= p["sep"] and c.dist(i, j) < p["threshold"] for i, j in c.pairs(p["threshold"]))
        assert got[qid]["n"] == want


def test_longest_helix_error(sets):
    _, rows = run("E5", sets)
    errs = {r["qid"].split("/")[1]: r["err"] for r in rows}
    assert errs["noh"] and errs["allh"] is None


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_program_texts_round_trip(sets, name):
    """Rendering a program and reading it back gives the same parameters and a
    template with the same plan."""
    q = generate.with_texts(questions_for(name, sets.chains(), 2))
    spaced = q.withColumn("program", F.regexp_replace("program", r"([(),])", " $1  "))
    back = programs.match_shapes(spaced.select("qid", "program", F.col("params").alias("want"), F.col("template").alias("asked")))
    rows = back.collect()
    assert rows
    for r in rows:
        want = dict(r["want"])
        if name == "F2":
            want["plddt_thr"] = 80.0
        assert r["params"] == want, r["program"]
        assert TEMPLATES[r["template"]].answer_type == TEMPLATES[name].answer_type


def test_every_template_answers(sets):
    """No template fails as a whole, and each answers questions it has drawn."""
    for name, t in TEMPLATES.items():
        q = questions_for(name, sets.chains().where("uniprot in ('c120', 'c80')"), 1)
        assert answer_template(name, q, sets).count() >= (0 if t.answer_type.endswith("Set") else 1), name


def test_programs_with_errors(spark, sets):
    texts = [
        ("a", "c120", "count r in all_residues where plddt(r) > 50"), ("b", "c120", "distance(residue(1), residue(500))"),
        ("c", "c120", "frobnicate(3)"), ("d", "c120", ""), ("e", "nope", "n_helices()"),
        ("f", "c120", "mean_plddt(range(0, 4))"),
        ("g", "c120", "if plddt(residue(3)) < 200 or plddt(residue(9)) < 300 then \"Unreliable\" else distance(residue(3), residue(9))"),
    ]
    df = spark.createDataFrame([(q, "human", u, p) for q, u, p in texts], "qid string, species string, uniprot string, program string")
    got = {r["qid"]: (r["answer"], r["err"]) for r in programs.run_programs(df, sets).collect()}
    assert got["a"][0] is not None and got["a"][1] is None
    assert got["b"] == (None, "residue index out of range") and got["d"] == (None, None)
    assert got["c"][1].startswith("unsupported program") and got["e"] == (None, "unknown chain")
    assert got["f"] == (None, "region out of range")
    assert got["g"][1].startswith("unsupported"), "two different literals for one parameter"


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_literals_as_rows_equal_listed_ones(sets, name):
    """A plan that knows the template's literal lists and one that takes every literal from its row agree."""
    if not TEMPLATES[name].literals():
        pytest.skip("no literals")
    q = questions_for(name, sets.chains(), 4)
    known, open_ = (answer_template(name, q, sets, drawn=d) for d in (True, False))
    shown = [c for c in known.columns if c != "f"]
    assert sorted(map(repr, known.select(*shown).collect())) == sorted(map(repr, open_.select(*shown).collect()))
    if "f" in known.columns:
        assert [r[0] for r in known.orderBy("qid").select(F.round("f", 7)).collect()] == [
            r[0] for r in open_.orderBy("qid").select(F.round("f", 7)).collect()]


HOSTILE = [
    "mean_plddt(range(1, 1000000000000))", "radius_of_gyration(range(1, 1000000000000))", "contact_density(range(1, 1000000000000))",
    "mean_plddt(first(99999999999)) < mean_plddt(last(99999999999))", "mean_pae(range(1, 999999999999), range(1, 999999999999))",
    "distance(residue(1), residue(99999999999999999999))", "mean_plddt(range(5, 2))", "radius_of_gyration(range(0, 4))",
    "argmin reg in sliding_window(99999999999) by mean_plddt(reg)", "argmin reg in sliding_window(0) by radius_of_gyration(reg)",
]
EMPTY = [
    ("exists reg in sliding_window(99999999999) where mean_plddt(reg) > 70", "false"),
    ("exists reg in sliding_window(99999999999) where mean_plddt(reg) > 70 and contact_density(reg) > 0.2", "false"),
    ("exists reg in sliding_window(0) where mean_plddt(reg) > 70", "false"),
    ("count r in all_residues where plddt(r) > 1e300", "0"), ("count r in all_residues where rel_sasa(r) < -1e300", "0"),
    ("size(filter (i, j) in all_pairs(min_sep=99999999999) where distance(i, j) < 8)", "0"),
    ("size(filter (i, j) in all_pairs(min_sep=20) where distance(i, j) < 0)", "0"),
]


def test_hostile_programs_are_values(spark, sets, named):
    """Programs whose numbers fit nothing end as an error or an empty answer of their own row, all in one batch."""
    fine = ("n_helices()", str(len(named["c120"].runs("H"))))
    far = ("size(filter (i, j) in all_pairs(min_sep=20) where distance(i, j) < 1e9)", str(100 * 101 // 2))
    texts = [*[(t, None) for t in HOSTILE], *EMPTY, fine, far]
    df = spark.createDataFrame([(str(k), "human", "c120", t) for k, (t, _) in enumerate(texts)], "qid string, species string, uniprot string, program string")
    got = {int(r["qid"]): r for r in programs.run_programs(df, sets).collect()}
    for k, (text, want) in enumerate(texts):
        assert got[k]["answer"] == want and (got[k]["err"] is None) == (want is not None), text


def test_any_number_of_literals_is_one_plan(spark, sets, named):
    """One threshold, separation and width per question, none of them listed; the plan does not grow with them."""
    def run(n):
        texts = [f"count r in all_residues where plddt(r) > {20 + k * 0.37:.2f}" for k in range(n)]
        texts += [f"size(filter (i, j) in all_pairs(min_sep={1 + k % 60}) where distance(i, j) < {2 + k * 0.31:.2f})" for k in range(n)]
        texts += [f"exists reg in sliding_window({1 + k}) where mean_plddt(reg) > {40 + k % 30}" for k in range(n)]
        df = spark.createDataFrame([(f"{c}/{k}", "human", c, t) for c in ("c120", "c80") for k, t in enumerate(texts)],
                                   "qid string, species string, uniprot string, program string")
        return texts, programs.run_programs(df, sets)

    few, many = (len(run(n)[1]._jdf.queryExecution().analyzed().toString()) for n in (2, 90))
    assert many < few + 100
    texts, out = run(90)
    got = {r["qid"]: r["answer"] for r in out.collect()}
    for name in ("c120", "c80"):
        c = named[name]
        pairs = [(j - i, c.dist(i, j)) for i in range(1, c.n + 1) for j in range(i + 1, c.n + 1)]
        for k in range(90):
            assert got[f"{name}/{k}"] == str(int((c.plddt > 20 + float(f"{k * 0.37:.2f}")).sum()))
            assert got[f"{name}/{90 + k}"] == str(sum(g >= 1 + k % 60 and d < float(f"{2 + k * 0.31:.2f}") for g, d in pairs))
            w = 1 + k
            tops = [float(c.plddt[i : i + w].mean(dtype="f8")) for i in range(c.n - w + 1)]
            assert got[f"{name}/{180 + k}"] == str(any(t > 40 + k % 30 for t in tops)).lower()
