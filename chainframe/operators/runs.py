"""Maximal runs of one label along a chain.

Runs are first formed inside blocks.  Only a run that touches a block border
can continue in the next block, so at most two rows per block take part in the
merge along the chain.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK, KEY
from .windows import in_block, neighbour_value, with_halo


def runs(residues: DataFrame, label: str | None = None) -> DataFrame:
    """KEY, ss, start, end of every maximal run, of one label or of all."""
    rows = with_halo(residues.select(*KEY, "i", "ss"))
    here = Window.partitionBy(*KEY, "_block", "ss").orderBy("i")
    local = (
        rows.withColumn("_island", F.row_number().over(in_block()) - F.row_number().over(here))
        .groupBy(*KEY, "_block", "ss", "_island")
        .agg(F.min("i").alias("start"), F.max("i").alias("end"))
    )
    if label is not None:
        local = local.where(F.col("ss") == label)
    at_start = (F.col("start") > 1) & (F.pmod(F.col("start") - 1, F.lit(BLOCK)) == 0)
    at_end = F.pmod(F.col("end"), F.lit(BLOCK)) == 0
    touching = at_start | at_end
    inner = local.where(~touching).select(*KEY, "ss", "start", "end")
    along = Window.partitionBy(*KEY, "ss").orderBy("start")
    fresh = (F.lag("end").over(along) + 1).eqNullSafe(F.col("start"))
    merged = (
        local.where(touching)
        .withColumn("_new", (~fresh).cast("int"))
        .withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEY, "ss", "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(*KEY, "ss", "start", "end")
    )
    return inner.unionByName(merged)


def longest_run(residues: DataFrame, label: str, groups: DataFrame | None = None) -> DataFrame:
    """The earliest of the longest runs; a chain without one gets ``err``."""
    size = F.col("end") - F.col("start") + 1
    best = (
        runs(residues, label)
        .groupBy(*KEY)
        .agg(F.min(F.struct((-size).alias("k"), "start", "end")).alias("b"))
        .select(*KEY, "b.start", "b.end", (-F.col("b.k")).alias("size"))
    )
    if groups is None:
        return best
    return groups.select(*KEY).join(best, KEY, "left").withColumn(
        "err", F.when(F.col("size").isNull(), F.lit("no run of that label"))
    )


def run_counts(residues: DataFrame, labels: list[str]) -> DataFrame:
    """Number of runs per label and chain (``n_H``, ``n_E``, ...)."""
    seen = neighbour_value(residues.select(*KEY, "i", "ss"), {"before": ("ss", -1)})
    begins = ~F.col("before").eqNullSafe(F.col("ss"))
    return seen.groupBy(*KEY).agg(
        *[F.count_if(begins & (F.col("ss") == v)).alias(f"n_{v}") for v in labels]
    )
