"""Readers, writers, streaming, structure kernels."""

import json
import math
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainframe.operators import structure
from chainframe.schema import PREDICTIONS, QUESTIONS, RESIDUES
from chainframe.sources import features, jsonl, structures
from chainframe.streaming import scoring as streaming


def atom(n, name, res, num, x, y, z, b, chain="A"):
    return f"ATOM  {n:5d} {name:<4s} {res} {chain}{num:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00{b:6.2f}           C"


@pytest.fixture
def structure_file(tmp_path):
    lines = ["HEADER    X", atom(1, " N", "ALA", 1, 0, 0, 0, 90.5), atom(2, " CA", "ALA", 1, 1.5, 0, 0, 90.5),
             atom(3, " CA", "XYZ", 3, 5, 0, 0, 40.25), atom(4, " CB", "ALA", 1, 9, 9, 9, 1), atom(5, " CA", "GLY", 1, 7, 7, 7, 5, "B")]
    (tmp_path / "AF-P12345-F1-model_v6.pdb").write_text("\n".join(lines))
    return tmp_path


def test_structure_files(spark, structure_file):
    lines = structures.read_lines(spark, str(structure_file / "*.pdb"), "human")
    bb = {r["i"]: r for r in structures.backbone(structures.parse_atoms(lines)).collect()}
    assert sorted(bb) == [1, 3] and bb[1]["aa"] == "A" and bb[3]["aa"] == "X"
    assert bb[1]["N"]["x"] == 0.0 and bb[1]["O"] == bb[1]["CA"]
    rows = {r["i"]: r for r in structures.residues_from_structure(lines).collect()}
    assert sorted(rows) == [1, 2, 3] and rows[2]["aa"] == "X" and rows[1]["length"] == 3
    assert rows[1]["n_neigh"] == 2 and abs(rows[3]["plddt"] - 40.25) < 1e-6
    compact = structures.compact_residues(structures.backbone(structures.parse_atoms(lines))).collect()
    assert sorted((r["i"], r["resnum"]) for r in compact) == [(1, 1), (2, 3)]
    assert structures.pool_of_files(spark, str(structure_file)).first()["uniprot"] == "P12345"


def test_pair_error_files(spark, tmp_path):
    (tmp_path / "AF-A1-F1-predicted_aligned_error_v6.json").write_text(json.dumps([{"predicted_aligned_error": [[0, 5.9], [7.2, 0]]}], indent=1))
    (tmp_path / "AF-B2-F1-predicted_aligned_error_v6.json").write_text(json.dumps({"predicted_aligned_error": [[0, 300], [1, 0]]}))
    rows = {(r["uniprot"], r["i"]): r for r in structures.read_pae_json(spark, str(tmp_path), "fly").collect()}
    assert rows[("A1", 1)]["pae"] == [0, 5] and rows[("A1", 2)]["pae"] == [7, 0]
    assert rows[("B2", 1)]["err"] and rows[("B2", 2)]["pae"] == [1, 0]


def test_feature_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    for name, n, pae in (("P1", 12, True), ("P2", 5, False)):
        np.savez(tmp_path / f"AF-{name}.npz", seq=np.array(["ACDEFGHIKLMN"[:n]]), residue_nums=np.arange(1, n + 1, dtype="u2"),
                 ca_xyz=rng.uniform(0, 30, (n, 3)).astype("f4"), plddt=rng.uniform(50, 95, n).astype("f4"), ss3=(np.arange(n) % 3).astype("u1"),
                 sasa=rng.uniform(0, 200, n).astype("f4"), pae=rng.integers(0, 30, (n, n)).astype("u1") if pae else np.zeros((0,), "u1"))
    (tmp_path / "AF-BAD.npz").write_bytes(b"not an archive")
    got = structures.read_archives(spark, str(tmp_path / "*.npz"), "human").cache()
    assert [r["uniprot"] for r in got.where("err is not null").collect()] == ["BAD"]
    rows = structures.archive_residues(got)
    assert rows.count() == 17 and "".join(r["ss"] for r in rows.where("uniprot='P2'").orderBy("i").collect()) == "HECHE"
    first = rows.where("uniprot = 'P1' and i = 1").first()
    assert abs(first["rel_sasa"] - min(first["sasa"] / 129.0, 1.5)) < 1e-6
    assert structures.archive_pae(got).count() == 12


def test_feature_tables_round_trip(spark, residues, tmp_path):
    features.write_features(residues, str(tmp_path / "f"))
    back = features.read_features(spark, str(tmp_path / "f"))
    assert back.exceptAll(residues).count() == 0 and back.count() == residues.count()
    names = {v: k for k, v in features.FILE_COLUMNS.items()}
    raw = residues.where("i % 2 = 1").select(*[F.col(c).alias(names[c]) for c in names])
    raw.write.parquet(str(tmp_path / "raw"))
    one = features.read_feature_parquet(spark, str(tmp_path / "raw"), "human", "c80")
    assert one.count() == 79 and one.where("i = 2").first()["aa"] == "X"
    with pytest.raises(ValueError):
        raw.drop("ca_x").write.parquet(str(tmp_path / "bad"))
        features.read_feature_parquet(spark, str(tmp_path / "bad"), "human")


def test_jsonl(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"qid": "a", "family": "A", "params": {"t": 3}}\n{"qid": "b", "fam\n{"qid": "a", "family": "Z"}\n')
    assert jsonl.read(spark, str(path), QUESTIONS).count() == 2
    with pytest.raises(Exception):
        jsonl.read(spark, str(path), QUESTIONS, strict=True).collect()
    from chainframe.plans.evaluate import last_per_question
    rows = last_per_question(jsonl.read_with_position(spark, str(path), QUESTIONS).where("qid is not null"), "position").collect()
    assert [(r["qid"], r["family"]) for r in rows] == [("a", "Z")]
    jsonl.write(jsonl.read(spark, str(path), QUESTIONS), str(tmp_path / "out"), ["family"])
    assert (tmp_path / "out" / "family=A").exists()


def test_streaming_scores_each_question_once(spark, tmp_path):
    source, results, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    def arrive(name, rows):
        spark.createDataFrame(rows, PREDICTIONS).coalesce(1).write.json(f"{source}/{name}")
    arrive("p1", [("a", "A", "A4", "Int", "5", "6"), ("b", "A", "A4", "Int", "5", "60")])
    for _ in range(2):
        streaming.score_stream(streaming.read_predictions(spark, source + "/*"), results, state).awaitTermination()
    arrive("p2", [("b", "A", "A4", "Int", "5", "5"), ("c", "A", "A4", "Int", "5", "5")])
    streaming.score_stream(streaming.read_predictions(spark, source + "/*"), results, state).awaitTermination()
    got = {r["qid"]: r["correct"] for r in spark.read.parquet(results).collect()}
    assert got == {"a": True, "b": False, "c": True} and spark.read.parquet(results).count() == 3


def test_streaming_takes_the_first_of_repeats(spark, tmp_path):
    """Repeats inside a file, over files and over batches; a replay from an older checkpoint changes nothing; earlier
    results are not read: they are gone when the last batch runs."""
    source, results, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(name, rows):
        spark.createDataFrame(rows, PREDICTIONS).coalesce(1).write.json(f"{source}/{name}")

    def run(into=results):
        streaming.score_stream(streaming.read_predictions(spark, source + "/*"), into, state).awaitTermination()

    row = lambda q, p: (q, "A", "A4", "Int", "5", p)
    arrive("p1", [row(f"q{k % 40}", "5" if k < 40 else "70") for k in range(400)] + [row(None, "5"), row(None, "70")])
    run()
    first = sorted((r["qid"] or "", r["correct"]) for r in spark.read.parquet(results).collect())
    assert first == sorted([(f"q{k}", True) for k in range(40)] + [("", True)])
    arrive("p2", [row(f"q{k}", "5" if k > 39 else "70") for k in range(30, 60)] + [row("q59", "70")])
    saved = str(tmp_path / "saved")
    shutil.copytree(state, saved)
    other = str(tmp_path / "other")
    run(other)

    def written(folder):
        # The log of the folder begins with the second batch, so its files are read by name.
        files = [str(f) for f in Path(folder).glob("part-*.parquet")]
        return sorted((r["qid"], r["correct"]) for r in spark.read.parquet(*files).collect())

    got = written(other)
    assert got == sorted((f"q{k}", True) for k in range(40, 60))
    # The same batch again, as after a failure before its commit.
    again = str(tmp_path / "again")
    streaming.score_stream(streaming.read_predictions(spark, source + "/*"), again, saved).awaitTermination()
    assert written(again) == got


def test_area_of_lone_and_touching_atoms(spark):
    df = spark.createDataFrame([("s", "p", 1, "CA", 0.0, 0.0, 0.0), ("s", "p", 9, "CA", 100.0, 0.0, 0.0), ("s", "q", 1, "CA", 0.0, 0.0, 0.0), ("s", "q", 2, "CA", 0.5, 0.0, 0.0)],
                               "species string, uniprot string, i long, atom string, x double, y double, z double")
    got = {(r["uniprot"], r["i"]): r["sasa"] for r in structure.exposed_area(df).collect()}
    whole = 4 * math.pi * (1.88 + 1.4) ** 2
    assert abs(got[("p", 1)] - whole) < 1e-3 and abs(got[("p", 9)] - whole) < 1e-3
    # Two spheres with centres d apart each lose a cap of height r - d / 2.
    left = whole * (1 - (3.28 - 0.25) / (2 * 3.28))
    assert abs(got[("q", 1)] - left) < 0.03 * whole and abs(got[("q", 2)] - left) < 0.03 * whole


def place(a, b, c, bond, angle, torsion):
    """The point at ``bond`` from c with the given angle and torsion."""
    angle, torsion = math.radians(angle), math.radians(torsion)
    bc = (c - b) / np.linalg.norm(c - b)
    n = np.cross(b - a, bc)
    n /= np.linalg.norm(n)
    m = np.cross(n, bc)
    d = np.array([-bond * math.cos(angle), bond * math.sin(angle) * math.cos(torsion), bond * math.sin(angle) * math.sin(torsion)])
    return c + d[0] * bc + d[1] * m + d[2] * n


def peptide(n, phi, psi):
    pts = [np.array([0.0, 0, 0]), np.array([1.458, 0, 0]), np.array([2.0, 1.42, 0])]
    for _ in range(n):
        pts.append(place(*pts[-3:], 1.329, 116.2, psi))
        pts.append(place(*pts[-3:], 1.458, 121.7, 180))
        pts.append(place(*pts[-3:], 1.525, 111.0, phi))
    rows = []
    for k in range(n):
        N, CA, C, nxt = pts[3 * k], pts[3 * k + 1], pts[3 * k + 2], pts[3 * k + 3]
        v = (C - CA) / np.linalg.norm(C - CA) + (C - nxt) / np.linalg.norm(C - nxt)
        rows.append((N, CA, C, C + 1.23 * v / np.linalg.norm(v)))
    return rows


def test_ideal_helix_is_a_helix(spark):
    point = lambda p: tuple(float(v) for v in p)
    rows = []
    for name, (phi, psi) in (("helix", (-57, -47)), ("extended", (-120, 130))):
        rows += [("s", name, k + 1, "A", *map(point, r)) for k, r in enumerate(peptide(16, phi, psi))]
    p = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"species string, uniprot string, i long, aa string, N {p}, CA {p}, C {p}, O {p}")
    got = {}
    for r in structure.assign_labels(df).orderBy("uniprot", "i").collect():
        got[r["uniprot"]] = got.get(r["uniprot"], "") + r["ss"]
    assert "H" * 10 in got["helix"] and got["helix"][0] == "C" and set(got["extended"]) == {"C"}


def test_schema_is_complete():
    assert RESIDUES.fieldNames()[:4] == ["species", "uniprot", "i", "length"]


def test_first_model_first_chain_last_record(spark, tmp_path):
    def line(chain, i, x, atom="CA"):
        return f"ATOM  {i:5d}  {atom:<3} ALA {chain}{i:4d}    {x:8.3f}{2.0:8.3f}{3.0:8.3f}  1.00{70.0:6.2f}"

    lines = ["MODEL        1", line("Z", 1, 9.0), line("Z", 1, 5.0), line("Z", 2, 6.0), line("A", 1, 7.0), "ENDMDL",
             "MODEL        2", line("Z", 1, 1.0), line("Z", 3, 1.0), "ENDMDL"]
    (tmp_path / "AF-P1-F1-model_v4.pdb").write_text("\n".join(lines) + "\n")
    bb = structures.backbone(structures.parse_atoms(structures.read_lines(spark, str(tmp_path), "human"))).collect()
    assert {(r["uniprot"], r["i"], r["CA"]["x"], r["C"]["x"]) for r in bb} == {("P1", 1, 5.0, 5.0), ("P1", 2, 6.0, 6.0)}
