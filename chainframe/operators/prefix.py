"""Running moments of chains, so that a region costs two lookups however long it is.

Features become whole numbers (``SCALE`` parts of one) and are summed exactly, so the difference of two running sums is
the exact sum in between and equal windows have equal values.  Sums run inside blocks and are shifted by the totals of
earlier blocks; no task holds a chain.

Extremes cannot be subtracted: each tile keeps its values and each segment of tiles its extremes.  A region reads parts
of its first and last tile and at most 30 segments per level of the tiles between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, TILE, block_of, tile_of
from .offline import segments_between, segments_of

SCALE = 1 << 32
WHOLE = "decimal(38,0)"


def whole(column: str) -> Column:
    """A feature as whole parts; ``feature=label`` is 1 where the feature has that label."""
    name, _, label = column.partition("=")
    if label:
        return F.when(F.col(name) == label, F.lit(SCALE)).otherwise(0).cast(WHOLE)
    return F.round(F.col(column).cast("double") * float(SCALE)).cast(WHOLE)


def running(residues: DataFrame, sums: list[str], squares: list[str]) -> DataFrame:
    """KEY, length, i from 0 on, and the sums up to and including i: ``s_<c>`` and, of squares, ``q_<c>``.

    NULL counts as 0; so does a square beyond 38 digits.
    """
    values = {f"s_{c}": F.coalesce(whole(c), F.lit(0).cast(WHOLE)) for c in sums}
    values |= {f"q_{c}": F.coalesce(F.try_multiply(whole(c), whole(c)), F.lit(0)).cast(WHOLE) for c in squares}
    rows = residues.select(*KEY, "length", F.col("i").cast("long").alias("i"), *[v.alias(n) for n, v in values.items()])
    rows = rows.withColumn("_block", block_of(F.col("i")))
    totals = rows.groupBy(*KEY, "_block").agg(*[F.sum(n).cast(WHOLE).alias(n) for n in values])
    earlier = Window.partitionBy(*KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*KEY, "_block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast(WHOLE).alias(f"_{n}") for n in values])
    inside = Window.partitionBy(*KEY, "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(*KEY, "length", "_block", "i", *[F.sum(n).over(inside).cast(WHOLE).alias(n) for n in values])
    out = local.join(before, [*KEY, "_block"]).select(
        *KEY, "length", "i", *[(F.col(n) + F.col(f"_{n}")).cast(WHOLE).alias(n) for n in values])
    zero = residues.where("i = 1").select(
        *KEY, "length", F.lit(0).cast("long").alias("i"), *[F.lit(0).cast(WHOLE).alias(n) for n in values])
    return out.unionByName(zero)


def mean_of(n: Column, total: Column) -> Column:
    return total.cast("double") / (n.cast("double") * float(SCALE))


def variance_of(n: Column, total: Column, squares: Column) -> Column:
    """Population variance; exact before the division unless the products pass 38 digits."""
    n = n.cast("decimal(20,0)")
    exact = (F.try_multiply(n, squares) - F.try_multiply(total, total)).cast("double")
    size, s = n.cast("double"), total.cast("double")
    spread = F.coalesce(exact, F.greatest(size * squares.cast("double") - s * s, F.lit(0.0)))
    return spread / (size * size * float(SCALE) * float(SCALE))


def sums_between(regions: DataFrame, index: DataFrame, rid: str = "qid") -> DataFrame:
    """rid and the index columns' sums over each region (KEY, start, end, length) within its chain."""
    names = [c for c in index.columns if c not in (*KEY, "length", "i")]
    valid = (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("length"))
    ends = F.array(
        F.struct(F.col("end").cast("long").alias("i"), F.lit(1).cast(WHOLE).alias("sign")),
        F.struct((F.col("start") - 1).cast("long").alias("i"), F.lit(-1).cast(WHOLE).alias("sign")),
    )
    wanted = regions.select(rid, *KEY, F.explode_outer(F.when(valid, ends)).alias("_e")).select(rid, *KEY, "_e.i", "_e.sign")
    signed = [F.sum(F.when(F.col("sign") > 0, F.col(n)).otherwise(-F.col(n))).cast(WHOLE).alias(n) for n in names]
    return wanted.join(index.drop("length"), [*KEY, "i"]).groupBy(rid).agg(*signed)


def extremes_between(regions: DataFrame, residues: DataFrame, columns: list[str], rid: str = "qid") -> DataFrame:
    """rid and, per column, ``lo_<c>`` and ``hi_<c>`` over each region (KEY, start, end, length) within its chain."""
    values = [F.col(c).cast("double").alias(c) for c in columns]
    tiles = residues.select(*KEY, "length", tile_of(F.col("i")).alias("_tile"), F.struct("i", *values).alias("_r")).groupBy(
        *KEY, "_tile").agg(F.max("length").alias("length"), F.array_sort(F.collect_list("_r")).alias("_rows"))
    both = [x for c in columns for x in (
        F.array_min(F.col("_rows")[c]).alias(f"lo_{c}"), F.array_max(F.col("_rows")[c]).alias(f"hi_{c}"))]
    names = [f"{side}_{c}" for c in columns for side in ("lo", "hi")]

    def merged(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[(F.min if n.startswith("lo_") else F.max)(n).alias(n) for n in names])

    top = F.floor((F.col("length") - 1) / TILE)
    levels = merged(
        tiles.select(*KEY, "_tile", top.alias("_top"), *both).select(*KEY, F.explode(segments_of("_tile", "_top")).alias("_s"), *names)
        .select(*KEY, "_s.level", "_s.seg", *names), [*KEY, "level", "seg"])
    valid = (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("length"))
    asked = regions.where(valid).select(rid, *KEY, "start", "end", tile_of(F.col("start")).alias("_a"), tile_of(F.col("end")).alias("_b"), top.alias("_top"))
    # The ends: one tile, or two of which each gives what lies inside the region.
    ends = asked.select(rid, *KEY, "start", "end", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_tile"))
    inside = ends.join(tiles.drop("length"), [*KEY, "_tile"]).withColumn(
        "_rows", F.filter("_rows", lambda r: r["i"].between(F.col("start"), F.col("end")))).select(rid, *both)
    full = asked.where("_b - _a > 1").select(rid, *KEY, (F.col("_a") + 1).alias("_a"), (F.col("_b") - 1).alias("_b"), "_top").select(
        rid, *KEY, F.explode(segments_between("_a", "_b", "_top")).alias("_s")).select(rid, *KEY, "_s.level", "_s.seg")
    middle = full.join(levels, [*KEY, "level", "seg"]).select(rid, *names)
    return merged(inside.unionByName(middle), [rid])
