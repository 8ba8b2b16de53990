"""Blocks of the pairwise error matrix.

The matrix is stored as one array per row position (``pae``), so a block is a
few rows found by an equi-join on (chain, position) and a slice of each; cells
are never turned into rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .regions import region_problem


def fit_to_length(pae: Column, length: Column) -> Column:
    """Pad with zeros or crop so that the row has one cell per position."""
    return F.transform(
        F.sequence(F.lit(1).cast("long"), length),
        lambda k: F.coalesce(F.try_element_at(pae, k.cast("int")), F.lit(0).cast("smallint")),
    )


def block_values(
    blocks: DataFrame, pae_rows: DataFrame, thresholds: Column | None = None, rid: str = "qid"
) -> DataFrame:
    """``blocks``: rid, KEY, a_start, a_end, b_start, b_end, length.

    Adds mean_pae, max_pae, n_high (cells above ``threshold`` when the column
    exists) and ``err``.
    """
    fits = F.expr("a_start >= 1 and a_start <= a_end and a_end <= length and b_start >= 1 and b_start <= b_end and b_end <= length")
    # explode_outer: the validity test stays in this step instead of being
    # pushed down as a filter that repeats how the regions were derived.
    positions = F.explode_outer(F.when(fits, F.sequence("a_start", "a_end")))
    wanted = blocks.withColumn("i", positions)
    cells = F.slice(
        F.col("pae"), F.col("b_start").cast("int"),
        (F.col("b_end") - F.col("b_start") + 1).cast("int"),
    )
    above = F.lit(0)
    if thresholds is not None:
        above = F.size(F.filter(F.col("_cells"), lambda v: v > F.col("_limit")))
    rows = (
        wanted.withColumn("_limit", thresholds if thresholds is not None else F.lit(None))
        .join(pae_rows.select(*KEY, "i", "pae"), [*KEY, "i"])
        .select(rid, "_limit", cells.alias("_cells"))
        .select(
            rid,
            F.aggregate("_cells", F.lit(0).cast("long"), lambda s, v: s + v).alias("_sum"),
            F.size("_cells").alias("_n"),
            F.array_max("_cells").alias("_top"),
            above.alias("_high"),
        )
    )
    values = rows.groupBy(rid).agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_pae"),
        F.max("_top").cast("double").alias("max_pae"),
        F.sum("_high").cast("long").alias("n_high"),
    )
    problem = F.coalesce(
        region_problem(F.col("a_start"), F.col("a_end"), F.col("length")),
        region_problem(F.col("b_start"), F.col("b_end"), F.col("length")),
        F.when(F.col("mean_pae").isNull(), F.lit("no pair matrix")),
    )
    out = blocks.join(values, rid, "left").withColumn("err", problem)
    ok = F.col("err").isNull()
    for name in ("mean_pae", "max_pae", "n_high"):
        out = out.withColumn(name, F.when(ok, F.col(name)))
    return out


def cell(pae: Column, j: Column) -> Column:
    """pae(i, j) from the stored row of i; NULL when there is none."""
    return F.try_element_at(pae, j.cast("int"))


def upper_triangle(pae: Column, i: Column) -> Column:
    """The cells (i, j) with j > i."""
    rest = F.greatest(F.size(pae) - i.cast("int"), F.lit(0))
    return F.when(rest > 0, F.slice(pae, i.cast("int") + 1, rest)).otherwise(
        F.array().cast("array<smallint>")
    )
