"""Secondary structure and exposed area from backbone coordinates.

Both follow published definitions and work on pairs of residues that are close
in space, found by the grid join: Kabsch and Sander 1983 for hydrogen bonds
and the helix and strand patterns, Shrake and Rupley 1973 for the area.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, literal_map
from .pairs import ALL_CELLS, close_pairs
from .windows import neighbour_value

# --- fixed values -------------------------------------------------------------
BOND_ENERGY = 0.084 * 332.0
BOND_CUTOFF = -0.5
NEAR = 9.0
TURN = 4
PROBE = 1.4
RADII = {"N": 1.64, "CA": 1.88, "C": 1.61, "O": 1.42}
# Atoms of side chains by element.
ELEMENT_RADII = {"C": 1.88, "N": 1.64, "O": 1.46, "S": 1.77}
OTHER_RADIUS = 1.80
SPHERE_POINTS = 100
# ------------------------------------------------------------------------------


def _minus(a: Column, b: Column) -> list[Column]:
    return [a[c].cast("double") - b[c].cast("double") for c in "xyz"]


def _length(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def _gap(a: Column, b: Column) -> Column:
    return _length(_minus(a, b))


def hydrogen_bonds(bb: DataFrame) -> DataFrame:
    """KEY, acceptor, donor: C=O of the acceptor to N-H of the donor.

    ``bb``: KEY, i, aa and the points N, CA, C, O.  The hydrogen lies one
    angstrom from N, opposite to the previous C=O.
    """
    linked = neighbour_value(bb, {"_pc": ("C", -1), "_po": ("O", -1)})
    back = _minus(F.col("_pc"), F.col("_po"))
    size = F.greatest(_length(back), F.lit(1e-9))
    hydrogen = F.struct(*[
        (F.col("N")[c].cast("double") + v / size).alias(c) for c, v in zip("xyz", back)
    ])
    sites = linked.select(
        *KEY, "i", "aa", "N", "C", "O", F.when(F.col("_pc").isNotNull(), hydrogen).alias("H"),
        *[F.col("CA")[c].alias(c) for c in "xyz"],
    )
    near = close_pairs(sites, NEAR, min_sep=2, keep=["aa", "N", "C", "O", "H"])

    def energy(acceptor, donor):
        c, o = F.col(f"C_{acceptor}"), F.col(f"O_{acceptor}")
        n, h = F.col(f"N_{donor}"), F.col(f"H_{donor}")
        inverse = lambda a, b: 1.0 / F.greatest(_gap(a, b), F.lit(0.5))
        value = F.lit(BOND_ENERGY) * (inverse(o, n) + inverse(c, h) - inverse(o, h) - inverse(c, n))
        return F.when(h.isNotNull() & (F.col(f"aa_{donor}") != "P"), value)

    both = F.array(
        F.struct(F.col("i").alias("acceptor"), F.col("j").alias("donor"), energy("i", "j").alias("e")),
        F.struct(F.col("j").alias("acceptor"), F.col("i").alias("donor"), energy("j", "i").alias("e")),
    )
    return near.select(*KEY, F.explode(both).alias("b")).where(F.col("b.e") < BOND_CUTOFF).select(
        *KEY, "b.acceptor", "b.donor"
    )


def assign_labels(bb: DataFrame) -> DataFrame:
    """KEY, i, ss in three states.

    Helix: two consecutive 4-turns.  Strand: residue in a parallel or
    antiparallel bridge, i.e. one of four patterns of two bonds.
    """
    bonds = hydrogen_bonds(bb)
    turns = bonds.where(F.col("donor") == F.col("acceptor") + TURN).select(*KEY, F.col("acceptor").alias("t"))
    second = turns.select(*KEY, (F.col("t") + 1).alias("t"))
    helix = turns.join(second, [*KEY, "t"]).select(
        *KEY, F.explode(F.sequence("t", F.col("t") + TURN - 1)).alias("i")
    ).distinct()

    a = bonds.select(*KEY, F.col("acceptor").alias("p"), F.col("donor").alias("q"))

    def pattern(key_of_first, key_of_second, residues):
        """Two bonds, matched on two shared positions."""
        left = a.select(*KEY, *[c.alias(n) for n, c in key_of_first.items()])
        right = a.select(*KEY, *[c.alias(n) for n, c in key_of_second.items()])
        found = left.join(right, [*KEY, *key_of_first])
        return found.where(F.abs(F.col("r") - F.col("s")) >= 3).select(*KEY, F.explode(F.array(*residues)).alias("i"))

    p, q = F.col("p"), F.col("q")
    r, s = F.col("r"), F.col("s")
    # Bond (p, q): C=O of p to N-H of q.  r and s are the bridged residues.
    parallel = pattern({"r": p + 1, "s": q}, {"r": q - 1, "s": p}, [r, s])
    anti_close = pattern({"r": p, "s": q}, {"r": q, "s": p}, [r, s])
    anti_wide = pattern({"r": p + 1, "s": q - 1}, {"r": q - 1, "s": p + 1}, [r, s])
    strand = parallel.unionByName(anti_close).unionByName(anti_wide).distinct()

    marked = (
        bb.select(*KEY, "i")
        .join(helix.withColumn("_h", F.lit(True)), [*KEY, "i"], "left")
        .join(strand.withColumn("_e", F.lit(True)), [*KEY, "i"], "left")
    )
    return marked.select(*KEY, "i", F.when(F.col("_h"), "H").when(F.col("_e"), "E").otherwise("C").alias("ss"))


def _sphere() -> Column:
    """Evenly spread unit vectors (golden spiral)."""
    turn = math.pi * (3.0 - math.sqrt(5.0))
    points = []
    for k in range(SPHERE_POINTS):
        z = 1.0 - (2 * k + 1) / SPHERE_POINTS
        ring = math.sqrt(1.0 - z * z)
        points.append(F.struct(
            F.lit(ring * math.cos(turn * k)).alias("x"), F.lit(ring * math.sin(turn * k)).alias("y"), F.lit(z).alias("z")
        ))
    return F.array(*points)


def atom_radius(atom: Column) -> Column:
    """The radius of an atom by its name in the file: backbone atoms have their own, others that of their element."""
    element = F.regexp_extract(F.upper(F.trim(atom)), "([A-Z])", 1)
    return F.coalesce(
        F.try_element_at(literal_map(RADII), atom), F.try_element_at(literal_map(ELEMENT_RADII), element), F.lit(OTHER_RADIUS)
    )


def exposed_area(atoms: DataFrame) -> DataFrame:
    """KEY, i, sasa: area of the residue's atoms that a probe can touch.

    ``atoms``: KEY, i, atom, x, y, z; any atoms of a residue, side chains included.  Atoms of one radius at one point are
    one site, worked out once and counted for each of them, so that points where many atoms were put do not meet one
    another.  Each site meets the sites near it (their number is bounded by how densely atoms pack) and counts the points
    of its sphere that lie in none of theirs.
    """
    reach = atom_radius(F.col("atom")) + PROBE
    at = ["w", "x", "y", "z"]
    solid = atoms.select(*KEY, "i", reach.alias("w"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    sites = solid.select(*KEY, *at).distinct()
    widest = 2 * (max(*RADII.values(), *ELEMENT_RADII.values(), OTHER_RADIUS) + PROBE)
    cells = [F.floor(F.col(c) / widest) for c in "xyz"]
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", shift)]) for shift in ALL_CELLS])).alias("_d")
    names = ["_cx", "_cy", "_cz"]
    seeing = sites.select(*KEY, *at, steps).select(
        *KEY, *at, *[(cell + F.col(f"_d.{c}")).alias(n) for cell, c, n in zip(cells, "xyz", names)])
    seen = sites.select(*KEY, *[F.col(c).alias(f"o{c}") for c in at], *[cell.alias(n) for cell, n in zip(cells, names)])
    same = F.lit(True)
    for c in at:
        same = same & (F.col(c) == F.col(f"o{c}"))
    gap = [F.col(c) - F.col(f"o{c}") for c in "xyz"]
    touch = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) < F.col("w") + F.col("ow")
    near = seeing.join(seen.hint("merge"), [*KEY, *names]).where(touch & ~same)
    around = near.groupBy(*KEY, *at).agg(F.collect_list(F.struct(*[F.col(f"o{c}").alias(c) for c in at])).alias("_near"))

    def free(p):
        spot = [F.col(c) + F.col("w") * p[c] for c in "xyz"]
        inside = lambda n: sum(((v - n[c]) * (v - n[c]) for v, c in zip(spot, "xyz")), F.lit(0.0)) < n["w"] * n["w"]
        return ~F.exists("_near", inside)

    opened = sites.join(around, [*KEY, *at], "left").withColumn("_near", F.coalesce("_near", F.array()))
    area = 4.0 * math.pi * F.col("w") * F.col("w") * F.size(F.filter(_sphere(), free)) / F.lit(float(SPHERE_POINTS))
    return solid.join(opened.select(*KEY, *at, area.alias("_area")), [*KEY, *at]).groupBy(*KEY, "i").agg(
        F.sum("_area").cast("float").alias("sasa")
    )
