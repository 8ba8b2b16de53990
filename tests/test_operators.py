"""Operators against direct computation, with blocks small enough that every
chain crosses several borders."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chainframe.operators import matrix, offline, pairs, quantify, ranking, regions, runs, windows
from chainframe.schema import KEY, RESIDUES
from chainframe.sources.features import densify
from conftest import Chain, frame

pytestmark = pytest.mark.usefixtures("small_blocks")


def by_chain(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["uniprot"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_sliding_windows(residues, chains):
    got = by_chain(windows.sliding_windows(residues, [5, 13], {"v": windows.mean("plddt")}), "w", "start", "end", "v")
    for c in chains:
        want = sorted(
            (w, s, s + w - 1, c.mean(s, s + w - 1)) for w in (5, 13) for s in range(1, c.n - w + 2)
        )
        have = got.get(c.name, [])
        assert [h[:3] for h in have] == [w[:3] for w in want]
        assert all(abs(h[3] - w[3]) < 1e-9 for h, w in zip(have, want))


def test_sliding_window_step(residues, chains):
    got = by_chain(windows.sliding_windows(residues, [6], {"v": windows.mean("plddt")}, step=5), "start")
    for c in chains:
        assert [s for (s,) in got.get(c.name, [])] == list(range(1, c.n - 6 + 2, 5))


def test_windows_wider_than_a_block(residues, chains):
    got = by_chain(windows.sliding_windows(residues, [50], {"v": windows.mean("plddt")}), "start")
    dense = by_chain(pairs.window_contacts(residues, pairs.close_pairs(residues, 8.0), [50]), "start", "density")
    for c in chains:
        starts = range(1, c.n - 50 + 2)
        assert [s for (s,) in got.get(c.name, [])] == list(starts)
        near = c.pairs(8.0)
        assert dense.get(c.name, []) == [(s, sum(s <= i and j <= s + 49 for i, j in near) / 1225) for s in starts]


def test_more_widths_than_one_pass(residues, monkeypatch):
    want = by_chain(windows.sliding_windows(residues, [3, 4, 5], {"v": windows.mean("plddt")}), "w", "start", "v")
    monkeypatch.setattr(windows, "MAX_FRAMES", 2)
    assert by_chain(windows.sliding_windows(residues, [3, 4, 5], {"v": windows.mean("plddt")}), "w", "start", "v") == want


def test_runs_across_blocks(residues, chains):
    for label in "HEC":
        got = by_chain(runs.runs(residues, label), "start", "end")
        for c in chains:
            assert got.get(c.name, []) == c.runs(label)


def test_longest_run_and_counts(residues, chains):
    groups = residues.where("i = 1").select("species", "uniprot")
    got = {r["uniprot"]: r for r in runs.longest_run(residues, "H", groups).collect()}
    counts = {r["uniprot"]: r for r in runs.run_counts(residues, ["H", "E"]).collect()}
    for c in chains:
        found = c.runs("H")
        assert counts[c.name]["n_H"] == len(found) and counts[c.name]["n_E"] == len(c.runs("E"))
        if not found:
            assert got[c.name]["err"]
            continue
        best = max(found, key=lambda r: (r[1] - r[0], -r[0]))
        assert (got[c.name]["start"], got[c.name]["end"]) == best


@pytest.mark.parametrize("radius", [5.0, 8.0, 12.0])
def test_close_pairs(residues, chains, radius):
    rows = pairs.close_pairs(residues, radius).collect()
    assert len(rows) == len({(r["uniprot"], r["i"], r["j"]) for r in rows})
    got = {}
    for r in rows:
        got.setdefault(r["uniprot"], set()).add((r["i"], r["j"]))
    for c in chains:
        assert got.get(c.name, set()) == c.pairs(radius)


def test_close_pairs_keeps_sides(residues, chains):
    named = {c.name: c for c in chains}
    for r in pairs.close_pairs(residues, 6.0, min_sep=3, keep=["ss"]).collect():
        c = named[r["uniprot"]]
        assert r["j"] - r["i"] >= 3 and (r["ss_i"], r["ss_j"]) == (c.ss[r["i"] - 1], c.ss[r["j"] - 1])


def test_close_between(residues, chains):
    got = by_chain(pairs.close_between(residues.where("ss='H'"), residues.where("ss='E'"), 7.0), "r", "s")
    for c in chains:
        want = sorted(
            (i, j) for i in range(1, c.n + 1) for j in range(1, c.n + 1)
            if c.ss[i - 1] == "H" and c.ss[j - 1] == "E" and c.dist(i, j) <= 7.0
        )
        assert got.get(c.name, []) == want


def test_coincident_and_boundary_points(spark):
    c = Chain("p", 4, 0)
    c.xyz[:] = [[0, 0, 0], [0, 0, 0], [8, 0, 0], [30, 0, 0]]
    df = frame(spark, [c])
    stored = {r["i"]: r["n_neigh"] for r in pairs.neighbor_counts(df).collect()}
    other = {r["i"]: r["n_neigh"] for r in pairs.neighbor_counts(df, 9.0).collect()}
    assert stored == {1: 2, 2: 2, 3: 2, 4: 0}
    assert other == {1: 1, 2: 1, 3: 2, 4: 0}


def test_window_contacts(residues, chains):
    contacts = pairs.close_pairs(residues, 8.0)
    got = by_chain(pairs.window_contacts(residues, contacts, [7, 12]), "w", "start", "density")
    for c in chains:
        near = c.pairs(8.0)
        want = sorted(
            (w, s, sum(s <= i and j <= s + w - 1 for i, j in near) / (w * (w - 1) / 2))
            for w in (7, 12) for s in range(1, c.n - w + 2)
        )
        assert got.get(c.name, []) == want


def test_split_pairs(residues, chains):
    got = {r["uniprot"]: r["answer"] for r in pairs.count_split_pairs(
        residues, F.col("ss") == "H", F.col("plddt") > 50, 4).collect()}
    for c in chains:
        want = sum(
            c.ss[i] == "H" and c.plddt[j] > 50 for i in range(c.n) for j in range(i + 4, c.n)
        )
        assert got.get(c.name, 0) == want


def test_pair_domain_size(spark):
    df = spark.createDataFrame([(1,), (5,), (40,)], "n long")
    got = [r[0] for r in df.select(pairs.pair_domain_size(F.col("n"), 3)).collect()]
    assert got == [sum(1 for i in range(n) for j in range(i + 3, n)) for n in (1, 5, 40)]


def test_region_values_and_errors(spark, residues, chains):
    asked = [(f"{c.name}/{k}", "human", c.name, c.n, s, e) for c in chains
             for k, (s, e) in enumerate([(1, 1), (3, 30), (0, 4), (9, 5), (1, 121), (1, c.n), (c.n, c.n), (2, c.n - 1), (1, 10**15)])]
    df = spark.createDataFrame(asked, "qid string, species string, uniprot string, length long, start long, end long")
    wanted = {"v": windows.mean("plddt"), "m": windows.highest("plddt"), "lo": windows.lowest("plddt"), "sd": windows.deviation("plddt"),
              "rg": windows.gyration(), "h": windows.occurrences("ss", "H")}
    got = {r["qid"]: r for r in regions.region_values(df, residues, wanted).collect()}
    named = {c.name: c for c in chains}
    for qid, _, name, _, s, e in asked:
        c = named[name]
        if s < 1 or e > c.n or s > e:
            assert got[qid]["err"] and got[qid]["v"] is None
        else:
            assert got[qid]["err"] is None and abs(got[qid]["v"] - c.mean(s, e)) < 1e-9
            part = c.plddt[s - 1 : e].astype("f8")
            assert got[qid]["m"] == part.max() and got[qid]["lo"] == part.min() and got[qid]["h"] == c.ss[s - 1 : e].count("H")
            assert abs(got[qid]["sd"] - part.std()) < 1e-7
            assert abs(got[qid]["rg"] - math.sqrt(c.xyz[s - 1 : e].astype("f8").var(0).sum())) < 1e-6


def test_region_contact_density(spark, residues, chains):
    asked = [(c.name, "human", c.name, c.n, min(2, c.n), min(c.n, 31)) for c in chains]
    df = spark.createDataFrame(asked, "qid string, species string, uniprot string, length long, start long, end long")
    got = {r["qid"]: r["density"] for r in regions.contact_density(df, pairs.close_pairs(residues, 9.0)).collect()}
    for name, _, _, n, s, e in asked:
        c = next(c for c in chains if c.name == name)
        size = e - s + 1
        want = 0.0 if size < 2 else sum(s <= i and j <= e for i, j in c.pairs(9.0)) / (size * (size - 1) / 2)
        assert abs(got[name] - want) < 1e-12


def test_matrix_blocks(spark, pae_rows, chains):
    asked = [(c.name, "human", c.name, c.n, 2, 9, 12, 30) for c in chains]
    df = spark.createDataFrame(asked, "qid string, species string, uniprot string, length long, a_start long, a_end long, b_start long, b_end long")
    got = {r["qid"]: r for r in matrix.block_values(df, pae_rows, F.lit(15)).collect()}
    for c in chains:
        r = got[c.name]
        if c.n < 30:
            assert r["err"] == "region out of range"
        elif c.name == "c35":
            assert r["err"] == "no pair matrix"
        else:
            block = c.pae[1:9, 11:30]
            assert abs(r["mean_pae"] - block.mean()) < 1e-9 and r["max_pae"] == block.max() and r["n_high"] == (block > 15).sum()


def test_ties_take_the_first(spark):
    c = Chain("t", 20, 0)
    c.plddt[:] = 50
    df = frame(spark, [c])
    scored = windows.sliding_windows(df, [4], {"v": windows.mean("plddt")})
    assert quantify.argmin(scored, F.col("v"), ["start"]).first()["start"] == 1
    assert quantify.argmax(scored, F.col("v"), ["start"]).first()["start"] == 1


def test_empty_domains(spark, residues):
    none = residues.where("false")
    groups = residues.where("i = 1").select("species", "uniprot")
    assert all(not r["answer"] for r in quantify.exists(none, F.lit(True), groups).collect())
    assert all(r["answer"] for r in quantify.forall(none, F.lit(False), groups).collect())
    assert all(r["answer"] == 0 for r in quantify.count(none, F.lit(True), groups).collect())
    assert all(r["err"] for r in quantify.argmin(none, F.col("plddt"), ["i"], groups=groups).collect())


def test_densify_fills_gaps(spark):
    c = Chain("g", 40, 3)
    kept = [r for r in c.rows() if r[2] % 3 != 0]
    df = spark.createDataFrame(kept, RESIDUES).drop("length")
    rows = {r["i"]: r for r in densify(df).collect()}
    assert sorted(rows) == list(range(1, 41)) and rows[3]["aa"] == "X" and rows[3]["ss"] == "C" and rows[3]["x"] == 0.0
    assert rows[4]["plddt"] == float(c.plddt[3]) and rows[4]["length"] == 40


def test_number_rows_matches_plain_numbering(spark):
    from pyspark.sql import Window

    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        (F.col("id") * 7919 % 997).alias("v"), "id",
    )
    got = ranking.number_rows(df, ["k"], ["v", "id"], F.floor(F.col("v") / 10), "i", "n")
    plain = df.withColumn("j", F.row_number().over(Window.partitionBy("k").orderBy("v", "id"))).select("id", "j")
    assert got.join(plain, "id").where("i != j").count() == 0 and got.count() == 5000


def test_pick_rank_is_the_upper_median(spark):
    df = spark.range(1001).select((F.col("id") % 7).alias("k"), ((F.col("id") * 31) % 113 / 3.0).alias("v"))
    got = {r["k"]: r["v"] for r in ranking.pick_rank(df, ["k"], "v", F.floor(F.col("n") / 2) + 1).collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r["k"], []).append(r["v"])
    assert got == {k: sorted(v)[len(v) // 2] for k, v in values.items()}


def test_segments_make_up_ranges(spark):
    """Every range is a disjoint union of segments, and only ranges inside the chain are."""
    top = 299
    asked = [(lo, hi, top) for lo in (0, 1, 15, 16, 17, 100, 255, 256, 299) for hi in (0, 15, 16, 31, 255, 256, 271, 298, 299, 300)] + [(-1, 5, top), (0, 0, 0)]
    df = spark.createDataFrame(asked, "lo long, hi long, top long")
    for r in df.select("*", offline.segments_between("lo", "hi", "top").alias("s")).collect():
        if not 0 <= r["lo"] <= r["hi"] <= r["top"]:
            assert r["s"] is None
            continue
        covered = sorted(i for x in r["s"] for i in range(x["seg"] << 4 * x["level"], (x["seg"] + 1) << 4 * x["level"]))
        assert covered == list(range(r["lo"], r["hi"] + 1))
        assert len(r["s"]) <= 30 * 3
    ends = spark.range(0, 300).select("id", F.lit(299).cast("long").alias("top")).select("id", offline.segments_of("id", "top").alias("s"))
    for r in ends.collect():
        assert [(x["level"], x["seg"]) for x in r["s"]] == [(k, r["id"] >> 4 * k) for k in range(3)]


def test_counts_of_literals(spark):
    """Thresholds as rows, equal and missing values, NULL and NaN included, against a plain count."""
    rng = random.Random(3)
    values = [("human", f"c{k % 3}", rng.choice([None, float("nan"), 1.5, 2.0, rng.uniform(-5, 90)]), rng.random()) for k in range(900)]
    asked = sorted({("human", f"c{k % 4}", rng.choice([1.5, 2.0, -1e300, 1e300, rng.uniform(-6, 95)])) for k in range(200)})
    v = spark.createDataFrame(values, "species string, uniprot string, v double, x double")
    a = spark.createDataFrame(asked, "species string, uniprot string, t double")
    got = {(r["uniprot"], r["t"]): r for r in offline.counts_upto(v, a).collect()}
    best = {(r["uniprot"], r["t"]): r["best"] for r in offline.best_above(v, a, KEY).collect()}
    assert len(got) == len(asked)
    for _, name, t in asked:
        own = [(w, x) for _, n, w, x in values if n == name and w is not None and w == w]
        assert (got[name, t]["below"], got[name, t]["upto"], got[name, t]["total"]) == (
            sum(w < t for w, _ in own), sum(w <= t for w, _ in own), len(own))
        assert best[name, t] == max((x for w, x in own if w > t), default=None)


def test_dominance_counts(spark):
    rng = random.Random(4)
    points = [("human", f"c{k % 2}", rng.randrange(0, 5000), rng.randrange(40) / 4, 5000) for k in range(1500)]
    asked = [(k, "human", f"c{k % 3}", *sorted((rng.randrange(0, 5001), rng.randrange(0, 5001))), rng.randrange(-2, 45) / 4, 5000) for k in range(120)]
    p = spark.createDataFrame(points, "species string, uniprot string, a long, b double, top long")
    q = spark.createDataFrame(asked, "qid long, species string, uniprot string, lo long, hi long, t double, top long")
    got = {r["qid"]: r for r in offline.counts_within(p, q).collect()}
    for k, _, name, lo, hi, t, _ in asked:
        own = [b for _, n, a, b, _ in points if n == name and lo <= a <= hi]
        if k in got:
            assert (got[k]["below"], got[k]["upto"]) == (sum(b < t for b in own), sum(b <= t for b in own))
        else:
            assert not own


def test_windows_of_asked_widths(spark, residues, chains):
    asked = [("human", c.name, c.n, w) for c in chains for w in (0, 1, 7, c.n, c.n + 1, 10**12)]
    df = spark.createDataFrame(asked, "species string, uniprot string, length long, w long")
    got = windows.asked_windows(residues, df, {"v": windows.mean("plddt"), "rg": windows.gyration()}).collect()
    want = {(c.name, w, s) for c in chains for w in (1, 7, c.n) if w <= c.n for s in range(1, c.n - w + 2)}
    assert {(r["uniprot"], r["w"], r["start"]) for r in got} == want and len(got) == len(want)
    named = {c.name: c for c in chains}
    for r in got:
        assert r["end"] == r["start"] + r["w"] - 1
        assert abs(r["v"] - named[r["uniprot"]].mean(r["start"], r["end"])) < 1e-9
        assert abs(r["rg"] - math.sqrt(named[r["uniprot"]].xyz[r["start"] - 1 : r["end"]].astype("f8").var(0).sum())) < 1e-6
