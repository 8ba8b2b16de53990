"""Readers of structure data as registered queries.  The file contents are
written by Spark from the vector chains, row by row, and read back by the
parser under test."""

import math

from pyspark.sql import functions as F

from ..operators import structure
from ..operators.matrix import fit_to_length
from ..schema import AA_THREE_TO_ONE, KEY, literal_map
from ..sources import structures
from ..sources.bindings import table, vector_chains, vector_matrix
from . import sql as S
from .workload import fixed

QUERIES, ORACLES = {}, {}
VC = f"WITH {S.VC} "


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def atom_lines(residues):
    """Fixed-column CA and N records (N shifted by one along x)."""
    three = literal_map({v: k for k, v in AA_THREE_TO_ONE.items()})
    atoms = F.explode(F.array(
        F.struct(F.lit(" CA ").alias("name"), F.lit(0.0).alias("dx")),
        F.struct(F.lit(" N  ").alias("name"), F.lit(1.0).alias("dx")),
    ))
    line = F.format_string(
        "ATOM  %5d %4s %3s A%4d    %8.3f%8.3f%8.3f  1.00%6.2f           C", F.col("i"), F.col("_a.name"),
        F.try_element_at(three, F.col("aa")), F.col("i"), F.col("x").cast("double") + F.col("_a.dx"),
        F.col("y").cast("double"), F.col("z").cast("double"), F.col("plddt").cast("double"),
    )
    return residues.select(*KEY, "i", "aa", "x", "y", "z", "plddt", atoms.alias("_a")).select(*KEY, line.alias("value"))


@register("parse_structure_lines", VC + "SELECT species, uniprot, i, aa, true AS ca_ok, true AS n_ok, true AS score_ok, true AS filled FROM vc")
def parse_structure_lines(spark, sf):
    """Fixed-column records to backbone points: within the three decimals the
    format keeps; absent C and O take the place of CA."""
    vc = vector_chains(spark, sf)
    bb = structures.backbone(structures.parse_atoms(atom_lines(vc)))
    truth = vc.select(*KEY, "i", F.struct("x", "y", "z").alias("_t"), F.col("plddt").alias("_s"))

    def near(point, shift=0.0):
        t = F.col("_t")
        same = F.lit(True)
        for c in "xyz":
            same = same & (F.abs(point[c].cast("double") - t[c].cast("double") - (shift if c == "x" else 0.0)) < 6e-4)
        return same

    return bb.join(truth, [*KEY, "i"]).select(
        *KEY, "i", "aa", near(F.col("CA")).alias("ca_ok"), near(F.col("N"), 1.0).alias("n_ok"),
        (F.abs(F.col("plddt").cast("double") - F.col("_s").cast("double")) < 6e-3).alias("score_ok"),
        ((F.col("C") == F.col("CA")) & (F.col("O") == F.col("CA"))).alias("filled"),
    )


@register("first_model_only", VC + "SELECT species, uniprot, i, aa, true AS ca_ok FROM vc")
def first_model_only(spark, sf):
    """Whole files with a second model, a later chain of an earlier name and
    repeated records: the first model, the first chain and the last record."""
    vc = vector_chains(spark, sf)
    moved = lambda d: vc.withColumn("x", F.col("x") + F.lit(d).cast("float"))
    named = F.regexp_replace("value", "^(.{21})A", "$1Z").alias("value")
    parts = [  # order in the file, lines
        (0, atom_lines(moved(5.0)).select(*KEY, named)), (1, atom_lines(vc).select(*KEY, named)), (2, atom_lines(moved(7.0))),
        (3, vc.select(*KEY).distinct().withColumn("value", F.lit("ENDMDL"))), (4, atom_lines(moved(-9.0)).select(*KEY, named)),
    ]
    rows = None
    for k, lines in parts:
        part = lines.withColumn("_k", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    listed = F.array_sort(F.collect_list(F.struct("_k", "value")))
    files = rows.groupBy(*KEY).agg(F.array_join(F.transform(listed, lambda r: r["value"]), "\n").alias("value"))
    bb = structures.backbone(structures.parse_atoms(structures.first_model(files)))
    truth = vc.select(*KEY, "i", *[F.col(c).cast("double").alias(f"_{c}") for c in "xyz"])
    same = F.lit(True)
    for c in "xyz":
        same = same & (F.abs(F.col("CA")[c].cast("double") - F.col(f"_{c}")) < 6e-4)
    return bb.join(truth, [*KEY, "i"]).select(*KEY, "i", "aa", same.alias("ca_ok"))


@register("residues_from_structure",VC + "SELECT species, uniprot, i, aa, 'C' AS ss, CAST(0 AS DOUBLE) AS sasa, length FROM vc")
def residues_from_structure(spark, sf):
    got = structures.residues_from_structure(atom_lines(vector_chains(spark, sf)))
    return got.select(*KEY, "i", "aa", "ss", F.col("sasa").cast("double").alias("sasa"), "length")


@register("parse_pair_matrix", f"WITH {S.VC_BASE}, {S.PAE} SELECT species, uniprot, i, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM pae GROUP BY ALL")
def parse_pair_matrix(spark, sf):
    """Whole JSON matrices, one document per chain, to rows."""
    rows = vector_matrix(spark, sf).select(*KEY, "i", F.transform("pae", lambda v: v + F.lit(0.9)).alias("r"))
    documents = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("m")).select(
        *KEY, F.to_json(F.struct(F.transform("m", lambda e: e["r"]).alias("predicted_aligned_error"))).alias("doc")
    )
    parsed = documents.select(*KEY, F.from_json("doc", "predicted_aligned_error array<array<double>>").alias("d"))
    got = structures.pae_rows(parsed.select(*KEY, F.col("d.predicted_aligned_error").alias("matrix")))
    return got.select(*KEY, "i", F.aggregate("pae", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.size("pae").cast("long").alias("n"))


@register("fitted_pair_matrix", f"WITH {S.VC_BASE}, {S.PAE} SELECT species, uniprot, i, any_value(length) + 5 AS n, CAST(sum(v) AS BIGINT) AS total FROM pae GROUP BY ALL")
def fitted_pair_matrix(spark, sf):
    """Rows padded with zeros to a longer chain."""
    got = vector_matrix(spark, sf).withColumn("pae", fit_to_length(F.col("pae"), F.col("length") + 5))
    return got.select(*KEY, "i", F.size("pae").cast("long").alias("n"), F.aggregate("pae", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


def _backbone(spark, sf):
    """Four points per vector position, around its CA."""
    v = vector_chains(spark, sf)
    at = lambda dx, dy, dz: F.struct(*[(F.col(c) + F.lit(d)).cast("float").alias(c) for c, d in zip("xyz", (dx, dy, dz))])
    return v.select(*KEY, "i", "aa", at(-1.2, 0.5, 0.4).alias("N"), at(0.0, 0.0, 0.0).alias("CA"), at(1.3, 0.6, 0.2).alias("C"), at(1.5, 1.7, 0.6).alias("O"))


def _point(name: str, at) -> str:
    return ", ".join(f"CAST(CAST(CAST({c} AS DOUBLE) + CAST({d} AS DOUBLE) AS FLOAT) AS DOUBLE) AS {name}{c}" for c, d in zip("xyz", at))


def _span(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in "xyz") + ")"


def _energy(acceptor: str, donor: str) -> str:
    near = lambda a, b: f"1.0 / greatest({_span(a, b)}, 0.5)"
    o, c, n, h = f"{acceptor}.o", f"{acceptor}.c", f"{donor}.n", f"{donor}.h"
    return f"CAST({structure.BOND_ENERGY!r} AS DOUBLE) * ({near(o, n)} + {near(c, h)} - {near(o, h)} - {near(c, n)})"


_BACK = _span("lc", "lo")
_BONDS = f"""pt AS (SELECT species, uniprot, i, aa, x, y, z, {_point('n', (-1.2, 0.5, 0.4))}, {_point('a', (0.0, 0.0, 0.0))}, {_point('c', (1.3, 0.6, 0.2))}, {_point('o', (1.5, 1.7, 0.6))} FROM vc),
  lk AS (SELECT *, {", ".join(f"lag({p}{c}) OVER (PARTITION BY species, uniprot ORDER BY i) AS l{p}{c}" for p in "co" for c in "xyz")} FROM pt),
  hy AS (SELECT *, {", ".join(f"n{c} + (lc{c} - lo{c}) / greatest({_BACK}, 1e-9) AS h{c}" for c in "xyz")} FROM lk),
  bp AS (SELECT u.species, u.uniprot, u.i AS acc, v.i AS don, {_energy('u', 'v')} AS e FROM hy u JOIN hy v ON u.species = v.species AND u.uniprot = v.uniprot AND abs(u.i - v.i) >= 2
    AND {_span('u.a', 'v.a')} <= 9.0 WHERE v.hx IS NOT NULL AND v.aa <> 'P'),
  bd AS (SELECT species, uniprot, acc AS p, don AS q FROM bp WHERE e < -0.5)"""
_BRIDGES = " UNION ALL ".join(
    f"SELECT species, uniprot, unnest([r, s]) AS i FROM (SELECT species, uniprot, {a} AS r, {b} AS s FROM bd) JOIN (SELECT species, uniprot, {c} AS r, {d} AS s FROM bd) USING (species, uniprot, r, s) WHERE abs(r - s) >= 3"
    for a, b, c, d in (("p + 1", "q", "q - 1", "p"), ("p", "q", "q", "p"), ("p + 1", "q - 1", "q - 1", "p + 1")))


@register("secondary_structure", f"""WITH {S.VC}, {_BONDS}, tn AS (SELECT species, uniprot, p AS t FROM bd WHERE q = p + 4),
  hx AS (SELECT DISTINCT species, uniprot, unnest(range(t, t + 4)) AS i FROM tn WHERE EXISTS (SELECT 1 FROM tn o WHERE o.species = tn.species AND o.uniprot = tn.uniprot AND o.t + 1 = tn.t)),
  st AS (SELECT DISTINCT species, uniprot, i FROM ({_BRIDGES}))
  SELECT vc.species, vc.uniprot, vc.i, CASE WHEN hx.i IS NOT NULL THEN 'H' WHEN st.i IS NOT NULL THEN 'E' ELSE 'C' END AS ss
  FROM vc LEFT JOIN hx ON hx.species = vc.species AND hx.uniprot = vc.uniprot AND hx.i = vc.i LEFT JOIN st ON st.species = vc.species AND st.uniprot = vc.uniprot AND st.i = vc.i""")
def secondary_structure(spark, sf):
    """Three-state labels from hydrogen bonds."""
    return structure.assign_labels(_backbone(spark, sf))


#: Atoms of a residue around its CA: name, place, radius.  SG is a side chain atom; of the two at one place each counts.
_ATOMS = [("N", (-1.2, 0.5, 0.4), 1.64), ("CA", (0.0, 0.0, 0.0), 1.88), ("C", (1.3, 0.6, 0.2), 1.61), ("O", (1.5, 1.7, 0.6), 1.42),
          ("SG", (-0.9, -1.6, 1.1), 1.77), ("CB", (-0.3, -1.1, 0.9), 1.88), ("CG", (-0.3, -1.1, 0.9), 1.88)]
_PLACED = " UNION ALL ".join(
    f"SELECT species, uniprot, i, {k} AS k, CAST({w} AS DOUBLE) + CAST(1.4 AS DOUBLE) AS w, " + ", ".join(
        f"CAST(CAST(CAST({c} AS DOUBLE) + CAST({d} AS DOUBLE) AS FLOAT) AS DOUBLE) AS {c}" for c, d in zip("xyz", at)) + " FROM vc"
    for k, (_, at, w) in enumerate(_ATOMS))


@register("exposed_area", f"""WITH {S.VC}, a AS ({_PLACED}),
  n AS (SELECT a.species, a.uniprot, a.i, a.k, a.w, a.x, a.y, a.z, b.w AS ow, b.x AS ox, b.y AS oy, b.z AS oz FROM a JOIN a b ON a.species = b.species AND a.uniprot = b.uniprot
    AND NOT (a.w = b.w AND a.x = b.x AND a.y = b.y AND a.z = b.z) AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < a.w + b.w),
  s AS (SELECT p, sqrt(1 - z * z) * cos({math.pi * (3.0 - math.sqrt(5.0))!r}::DOUBLE * p) AS px, sqrt(1 - z * z) * sin({math.pi * (3.0 - math.sqrt(5.0))!r}::DOUBLE * p) AS py, z AS pz
    FROM (SELECT p, CAST(1 AS DOUBLE) - (2 * p + 1) / CAST(100 AS DOUBLE) AS z FROM (SELECT unnest(range(0, 100)) AS p))),
  h AS (SELECT n.species, n.uniprot, n.i, n.k, count(DISTINCT p) AS hidden FROM n, s
    WHERE (x + w * px - ox) * (x + w * px - ox) + (y + w * py - oy) * (y + w * py - oy) + (z + w * pz - oz) * (z + w * pz - oz) < ow * ow GROUP BY ALL)
  SELECT a.species, a.uniprot, a.i, {S.fixed(f"sum(4 * CAST({math.pi!r} AS DOUBLE) * w * w * (100 - coalesce(hidden, 0)) / 100)", 2)} AS sasa
  FROM a LEFT JOIN h ON h.species = a.species AND h.uniprot = a.uniprot AND h.i = a.i AND h.k = a.k GROUP BY ALL""")
def exposed_area(spark, sf):
    """Accessible area per residue, side chain atoms included."""
    vc = vector_chains(spark, sf)
    atoms = vc.select(*KEY, "i", F.explode(F.array(*[
        F.struct(F.lit(name).alias("atom"), *[(F.col(c) + F.lit(d)).cast("float").alias(c) for c, d in zip("xyz", at)]) for name, at, _ in _ATOMS
    ])).alias("e")).select(*KEY, "i", "e.atom", "e.x", "e.y", "e.z")
    return structure.exposed_area(atoms).withColumn("sasa", fixed(F.col("sasa").cast("double"), 2))


@register("files_without_partner", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def files_without_partner(spark, sf):
    """Ids of one listing that the other lacks."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
