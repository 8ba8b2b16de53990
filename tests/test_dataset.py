"""Generation, splits, samples, exemplars, gates."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chainframe.plans import gates, generate, hard_negatives, prompts, splits
from chainframe.plans.templates import TEMPLATES, ChainSet


@pytest.fixture(scope="module")
def sets(residues, pae_rows):
    return ChainSet(residues, pae_rows)


@pytest.fixture(scope="module")
def questions(sets):
    rows = generate.candidates(sets.chains(), {"main": 6, "G": 1, "H": 1}, with_matrix=False)
    return generate.with_texts(generate.choose(rows, {"main": 6, "G": 1, "H": 1})).cache()


def test_generated_questions_are_distinct_and_counted(questions):
    rows = questions.collect()
    keys = Counter((r["uniprot"], r["template"], tuple(sorted(r["params"].items()))) for r in rows)
    assert rows and max(keys.values()) == 1
    assert len({r["qid"] for r in rows}) == len(rows)
    per_chain = Counter(r["uniprot"] for r in rows)
    assert max(per_chain.values()) <= 8 and per_chain["c120"] == 8
    assert not any("{" in r["question"] or "{" in r["program"] for r in rows)
    assert all(r["answer_type"] == TEMPLATES[r["template"]].answer_type for r in rows)


def test_question_texts_mention_their_numbers(questions):
    checked = gates.surface_check(questions.where("family not in ('Ha', 'Hb', 'F')"))
    assert checked.where("not ok_numbers or not ok_keyword").count() == 0


def test_no_wording_contains_its_program(questions):
    assert questions.where(gates.leaks_program(F.col("question"))).count() == 0


def test_hard_negatives_differ(sets, questions):
    q = questions.where("template in ('A4', 'B2', 'D3', 'G3')").drop("question", "program", "paraphrase_id")
    answered = q.join(generate.answer_all(q, sets, ["A4", "B2", "D3", "G3"]).drop("err"), "qid").cache()
    mined = hard_negatives.mine(answered, sets, ["A4", "B2", "D3", "G3"]).collect()
    old = {r["qid"]: r for r in answered.collect()}
    assert mined
    for r in mined:
        assert r["qid"] == f"{r['hn_source_qid']}/{r['hn_class']}" and r["is_hard_negative"]
        assert r["params"] != old[r["hn_source_qid"]]["params"] and r["answer"] != old[r["hn_source_qid"]]["answer"]


def test_hard_negatives_work_out_positives_once(sets, questions):
    q = questions.where("template = 'A4' and qid <> 'marked'").drop("question", "program", "paraphrase_id")
    answered = q.join(generate.answer_all(q, sets, ["A4"]).drop("err"), "qid").where("qid <> 'marked'")
    mined = hard_negatives.mine(answered, sets, ["A4"])
    assert "marked" not in mined._jdf.queryExecution().analyzed().toString()


def test_allocation():
    rng = random.Random(1)
    for _ in range(200):
        counts = {(k,): rng.randint(1, 400) for k in range(rng.randint(1, 12))}
        target, floor = rng.randint(1, 900), rng.choice([0, 5, 30])
        got = splits.allocate(counts, target, floor)
        assert all(0 <= got[k] <= n for k, n in counts.items())
        total = sum(got.values())
        # Off target only when nothing can move any more.
        if total < target:
            assert all(got[k] == n for k, n in counts.items())
        if total > target:
            assert all(v <= floor for v in got.values())


def test_stratified_sample_takes_the_allocation(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("qid"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("cell")
    )
    got = splits.stratified_sample(rows, 300, ["cell"], floor=10)
    sizes = {(r["cell"],): r["count"] for r in rows.groupBy("cell").count().collect()}
    assert {(r["cell"],): r["count"] for r in got.groupBy("cell").count().collect()} == splits.allocate(sizes, 300, 10)
    assert got.select("qid").distinct().count() == 300


def test_split_sizes_and_disjointness(spark):
    q = spark.range(3000).select(
        F.col("id").cast("string").alias("qid"), F.when(F.col("id") % 2 == 0, "human").otherwise("fly").alias("species"),
        F.concat(F.lit("P"), F.col("id") % 211).alias("uniprot"), F.lit("A").alias("family"), F.lit("A1").alias("template"),
    )
    parts = splits.protein_partition(q)
    n = parts.count()
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sizes["train"] == round(n * 0.8) and sizes["dev"] == round(n * 0.1)
    rows = splits.compose(q, q.limit(0))
    assert rows.count() == 3000
    gate = {r["gate"]: r for r in gates.gate_table(rows.withColumn("hn_class", F.lit(None).cast("string"))).collect()}
    assert gate["protein_disjointness"]["passed"] and gate["cross_species_pure"]["passed"] and not gate["schema"]["passed"]


def test_exemplars_follow_the_tiers(spark):
    rng = random.Random(5)
    train = [(f"t{k}", f"P{rng.randint(0, 3)}", t[0], t) for k, t in enumerate(rng.choices(["A1", "A2", "B1"], [6, 1, 2], k=40))]
    targets = [(f"q{k}", f"P{rng.randint(0, 3)}", t[0], t) for k, t in enumerate(rng.choices(["A1", "A2", "B1", "C1"], k=30))]
    schema = "qid string, uniprot string, family string, template string"
    got = {}
    for r in prompts.pick_exemplars(spark.createDataFrame(train, schema), spark.createDataFrame(targets, schema), 5).collect():
        got.setdefault(r["target"], {})[r["exemplar"]] = r["tier"]
    info = {t[0]: t for t in train}
    for qid, uniprot, family, template in targets:
        picks = got[qid]
        assert len(picks) == 5
        first = [t for t in train if t[3] == template and t[1] != uniprot]
        second = [t for t in train if t[2] == family and t[3] != template]
        assert sum(v == 1 for v in picks.values()) == min(5, len(first))
        assert sum(v == 2 for v in picks.values()) == min(5 - min(5, len(first)), len(second))
        for name, tier in picks.items():
            _, u, f, t = info[name]
            assert {1: t == template and u != uniprot, 2: f == family and t != template, 3: f != family}[tier]


def test_digest_ignores_order_but_not_content(spark):
    df = spark.range(500).select(F.col("id").alias("qid"), (F.col("id") * 3).alias("v"))
    one = splits.digest(df, "qid").first()["digest"]
    assert splits.digest(df.orderBy(F.desc("qid")).repartition(7), "qid").first()["digest"] == one
    assert splits.digest(df.withColumn("v", F.when(F.col("qid") == 7, 0).otherwise(F.col("v"))), "qid").first()["digest"] != one
