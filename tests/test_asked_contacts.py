"""Contact counts for literals that are rows: few or many questions per chain."""

import pytest
from pyspark.sql import functions as F

from chainframe.operators import pairs
from chainframe.schema import KEY
from conftest import Chain, frame


@pytest.fixture(scope="module")
def asked(spark, chains):
    """Questions of each chain: usual ones, a distance that some pair is at, one that nothing is near or beyond."""
    rows = []
    for c in chains:
        exact = [c.dist(1, 4), c.dist(2, 9)] if c.n > 8 else []
        for n, (sep, t) in enumerate([(1, 8.0), (5, 8.0), (5, 12.5), (0, 3.0), (3, -1.0), (2, 1e6), (500, 8.0), *[(2, d) for d in exact]]):
            rows.append((f"{c.name}/{n}", "human", c.name, c.n, sep, t))
    return rows, spark.createDataFrame(rows, "qid string, species string, uniprot string, length long, sep int, t double")


@pytest.mark.parametrize("few", [64, 8, 0])
def test_counts_with_few_and_many_questions(residues, chains, asked, monkeypatch, few):
    monkeypatch.setattr(pairs, "FEW", few)
    by_name, (rows, df) = {c.name: c for c in chains}, asked
    got = {r["qid"]: (r["below"], r["upto"]) for r in pairs.asked_contact_counts(residues, df).collect()}
    for qid, _, name, n, sep, t in rows:
        d = [by_name[name].dist(i, j) for i in range(1, n + 1) for j in range(i + max(1, sep), n + 1)]
        assert got[qid] == (sum(x < t for x in d), sum(x <= t for x in d)), qid


def test_pairs_become_points_before_they_are_counted(spark, monkeypatch):
    """One question of a chain leaves its pairs two points at most, whatever their number."""
    seen, counted = [], pairs.counts_within
    monkeypatch.setattr(pairs, "counts_within", lambda points, *a, **k: seen.append(points) or counted(points, *a, **k))
    c = Chain("one", 200, 9, edge=20)
    df = spark.createDataFrame([("q", "human", "one", 200, 3, 9.0)], "qid string, species string, uniprot string, length long, sep int, t double")
    got = pairs.asked_contact_counts(frame(spark, [c]), df).collect()
    assert got[0]["upto"] == sum(j - i >= 3 for i, j in c.pairs(9.0)) > 1000
    assert seen[0].groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).collect()[0]["n"] <= 2
