"""Values of regions.

Many regions at once: ``regions`` holds KEY, an identifier, start, end and the chain's length.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, TILE
from .offline import counts_within
from .prefix import extremes_between, running, sums_between
from .windows import Metric, listed


def region_problem(start: Column, end: Column, length: Column) -> Column:
    """Error text for a region that leaves the chain, else NULL."""
    bad = length.isNull() | (start < 1) | (end > length) | (start > end)
    return F.when(bad, F.lit("region out of range"))


def position_problem(i: Column, length: Column) -> Column:
    return F.when(
        length.isNull() | i.isNull() | (i < 1) | (i > length), F.lit("residue index out of range")
    )


def region_values(
    regions: DataFrame, residues: DataFrame, metrics: dict[str, Metric], rid: str = "qid"
) -> DataFrame:
    """One row per region (rid, KEY, start, end, length and further columns): its columns, the metrics and ``err``.

    A region costs two lookups in the running sums, and for extremes a few segments; see ``prefix``.
    """
    found = regions.withColumn("err", region_problem(F.col("start"), F.col("end"), F.col("length")))
    sums, squares, extremes = (listed(metrics, k) for k in ("sums", "squares", "extremes"))
    if sums:
        found = found.join(sums_between(regions, running(residues, sums, squares), rid), rid, "left")
    if extremes:
        found = found.join(extremes_between(regions, residues, extremes, rid), rid, "left")
    n = F.col("end") - F.col("start") + 1
    valid = F.col("err").isNull()
    return found.select(*regions.columns, *[F.when(valid, m.finish(n)).alias(name) for name, m in metrics.items()], "err")


def fixed_region(residues: DataFrame, start, end, metrics: dict[str, Metric]) -> DataFrame:
    """The same region of every chain; ``start`` / ``end`` may use ``length``.

    Chains that the region does not fit get ``err`` and NULL values.
    """
    start = start if isinstance(start, Column) else F.lit(start)
    end = end if isinstance(end, Column) else F.lit(end)
    problem = region_problem(start, end, F.col("length"))
    tagged = residues.withColumn("_err", problem)
    # A chain that fails keeps its first row so that it is reported.
    rows = tagged.where(
        (F.col("_err").isNull() & F.col("i").between(start, end))
        | (F.col("_err").isNotNull() & (F.col("i") == 1))
    )
    values = rows.groupBy(*KEY).agg(
        F.max("_err").alias("err"), *[m.grouped().alias(n) for n, m in metrics.items()]
    )
    return values.select(
        *KEY, *[F.when(F.col("err").isNull(), F.col(n)).alias(n) for n in metrics], "err"
    )


def first_n(n: int) -> tuple[Column, Column]:
    return F.lit(1), F.lit(n)


def last_n(n: int) -> tuple[Column, Column]:
    return F.col("length") - n + 1, F.col("length")


def window_of(start: int, size: int) -> tuple[Column, Column]:
    return F.lit(start), F.lit(start + size - 1)


def contact_counts(regions: DataFrame, contacts: DataFrame, rid="qid", min_gap=0) -> DataFrame:
    """Contacts whose two ends lie in the region (and j - i > min_gap): rid, contacts; regions without any are missing.

    ``regions`` carries ``length``.  Counted by dominance (first end inside, second end up to the region's end), so
    nested long regions share their work and no region meets its contacts one by one.
    """
    asked = regions.select(
        rid, *KEY, F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"),
        F.col("end").cast("double").alias("t"), F.col("length").cast("long").alias("top"),
    )
    lengths = asked.groupBy(*KEY).agg(F.max("top").alias("top"))
    points = contacts.where(F.col("j") - F.col("i") > min_gap).join(lengths, KEY).select(
        *KEY, F.col("i").cast("long").alias("a"), F.col("j").cast("double").alias("b"), "top")
    found = counts_within(points, asked, rid, cell=lambda v: F.floor(v / TILE))
    return found.select(rid, F.col("upto").alias("contacts"))


def contact_density(regions: DataFrame, contacts: DataFrame, rid="qid") -> DataFrame:
    """Contacts over possible pairs; a region of one position has density 0.

    ``regions`` must carry ``length`` for the bounds check.
    """
    found = contact_counts(regions, contacts, rid)
    size = F.col("end") - F.col("start") + 1
    problem = region_problem(F.col("start"), F.col("end"), F.col("length"))
    density = F.when(size < 2, F.lit(0.0)).otherwise(
        F.coalesce(F.col("contacts"), F.lit(0)) / (size * (size - 1) / 2)
    )
    return (
        regions.join(found, rid, "left")
        .withColumn("err", problem)
        .withColumn("density", F.when(F.col("err").isNull(), density))
        .drop("contacts")
    )
