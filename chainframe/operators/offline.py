"""Answers for literals that are rows.

Questions bring their own thresholds, separations and ranges, so a plan must not depend on how many there are.  Literals
are put among the values they are compared with; one running count (or maximum) in value order then answers all of them.
Values are cut into cells that are ordered among themselves; a cell is counted alone and shifted by the totals of the
cells before it, so a group with most rows is spread over its cells.

Ranges of positions are sums of *segments*: a position lies in one segment of each level (its number without the last
0, 1, 2, ... hexadecimal digits), and a range is the union of at most 30 segments per level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY

Cell = Callable[[Column], Column]


def unit_cell(v: Column) -> Column:
    return F.floor(v)


def _points(values: DataFrame, asked: DataFrame, by: list[str], v: str, t: str, kept: Column, cell: Cell) -> DataFrame:
    """Distinct values and literals of each group: by, _v, _x (``kept`` aggregated by count or maximum), _asked, _cell."""
    number = F.col("_v").isNotNull() & ~F.isnan("_v")
    seen = values.select(*by, F.col(v).cast("double").alias("_v"), kept.alias("_x"), F.lit(False).alias("_asked"))
    wanted = asked.select(*by, F.col(t).cast("double").alias("_v")).distinct().select(
        *by, "_v", F.lit(None).cast(seen.schema["_x"].dataType).alias("_x"), F.lit(True).alias("_asked"))
    return seen.unionByName(wanted).where(number).withColumn("_cell", cell(F.col("_v")))


def counts_upto(
    values: DataFrame, asked: DataFrame, by: list[str] = KEY, v: str = "v", t: str = "t", cell: Cell = unit_cell,
    times: Column | None = None,
) -> DataFrame:
    """by, ``t``, below (values < t), upto (values <= t), total; one row for each distinct literal of ``asked``.

    NULL and NaN values are not counted, such literals have no row.  ``cell`` must not decrease along the values.  A value
    counts as often as ``times`` says, once by default.
    """
    kept = (F.lit(1) if times is None else times).cast("long")
    points = _points(values, asked, by, v, t, kept, cell).groupBy(*by, "_cell", "_v").agg(
        F.coalesce(F.sum("_x"), F.lit(0)).alias("_x"), F.bool_or("_asked").alias("_asked"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = points.groupBy(*by, "_cell").agg(F.sum("_x").alias("_n")).select(
        *by, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("total"))
    inside = Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = points.withColumn("_run", F.sum("_x").over(inside)).where("_asked").join(cells, [*by, "_cell"])
    upto = F.col("_before") + F.col("_run")
    return found.select(*by, F.col("_v").alias(t), (upto - F.col("_x")).alias("below"), upto.alias("upto"), "total")


def best_above(
    values: DataFrame, asked: DataFrame, by: list[str], v: str = "v", x: str = "x", t: str = "t", cell: Cell = unit_cell
) -> DataFrame:
    """by, ``t``, best: the largest ``x`` among the values above ``t``; NULL if none is."""
    points = _points(values, asked, by, v, t, F.col(x), cell).groupBy(*by, "_cell", "_v").agg(
        F.max("_x").alias("_x"), F.bool_or("_asked").alias("_asked"))
    above = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = points.groupBy(*by, "_cell").agg(F.max("_x").alias("_n")).select(*by, "_cell", F.max("_n").over(above).alias("_above"))
    inside = Window.partitionBy(*by, "_cell").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    found = points.withColumn("_run", F.max("_x").over(inside)).where("_asked").join(cells, [*by, "_cell"])
    # greatest() skips NULLs.
    return found.select(*by, F.col("_v").alias(t), F.greatest("_run", "_above").alias("best"))


def segments_of(at: str, top: str) -> Column:
    """The segments that hold position ``at`` (0-based, at most ``top``): an array of (level, seg)."""
    return F.expr(f"transform(sequence(0, length(hex({top})) - 1), k -> struct(k AS level, shiftright({at}, 4 * k) AS seg))")


def segments_between(lo: str, hi: str, top: str) -> Column:
    """The fewest segments that make up positions ``lo`` to ``hi`` (0-based, inclusive, at most ``top``); none if the
    range is empty or does not lie within 0 to ``top``."""
    levels = f"""transform(sequence(0, length(hex({top})) - 1), k -> struct(k AS k,
        shiftright({lo} + shiftleft(1L, 4 * k) - 1, 4 * k) AS a, shiftright({hi} + 1, 4 * k) AS b))"""
    # What is left of level k after its groups of 16 went to level k + 1.
    ends = f"""transform({levels}, l -> struct(l.k AS k, l.a AS a, l.b AS b,
        IF(l.k = length(hex({top})) - 1, l.b, 16L * shiftright(l.a + 15, 4)) AS a2,
        IF(l.k = length(hex({top})) - 1, l.b, 16L * shiftright(l.b, 4)) AS b2))"""
    run = "CASE WHEN {0} < {1} THEN sequence({0}, {1} - 1) ELSE CAST(array() AS array<bigint>) END"
    parts = f"""transform({ends}, l -> transform(CASE WHEN l.a2 >= l.b2 THEN {run.format('l.a', 'l.b')}
        ELSE concat({run.format('l.a', 'l.a2')}, {run.format('l.b2', 'l.b')}) END, s -> struct(l.k AS level, s AS seg)))"""
    return F.expr(f"CASE WHEN {lo} >= 0 AND {lo} <= {hi} AND {hi} <= {top} THEN flatten({parts}) END")


def counts_within(
    points: DataFrame, asked: DataFrame, rid: str = "qid", by: list[str] = KEY, cell: Cell = unit_cell,
    times: Column | None = None,
) -> DataFrame:
    """Dominance counting.  ``points``: by, a, b, top; ``asked``: rid, by, lo, hi, t, top.  Returns rid, below and upto: how
    many points of the group have lo <= a <= hi and b < t (b <= t).  ``a`` is 0-based and at most ``top``, which is the
    same for all rows of a group.  Asked rows without points, or with a range outside 0 to ``top``, are missing.

    Neither side meets the other: a point is counted in one segment per level of ``a``, a range reads its segments.  It
    counts as often as ``times`` says, once by default.
    """
    keys = [*by, "level", "seg"]
    often = (F.lit(1) if times is None else times).alias("_times")
    placed = points.select(*by, "b", often, F.explode(segments_of("a", "top")).alias("_s")).select(*by, "_s.level", "_s.seg", "b", "_times")
    # explode_outer keeps the validity test in this step; as a filter it would repeat how the range was derived.
    wanted = asked.select(rid, *by, F.col("t").cast("double").alias("t"), F.explode_outer(segments_between("lo", "hi", "top")).alias("_s"))
    wanted = wanted.select(rid, *by, "_s.level", "_s.seg", "t")
    counted = counts_upto(placed, wanted, keys, "b", "t", cell, F.col("_times"))
    return wanted.join(counted.hint("merge"), [*keys, "t"]).groupBy(rid).agg(F.sum("below").alias("below"), F.sum("upto").alias("upto"))
