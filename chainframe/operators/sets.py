"""Set operators, on element rows and on arrays.

Element rows (one row per member) are the general form; the array forms are
for sets that belong to a single row, such as a parsed answer.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY


def union(a: DataFrame, b: DataFrame, columns=("i",)) -> DataFrame:
    cols = [*KEY, *columns]
    return a.select(*cols).unionByName(b.select(*cols)).distinct()


def intersection(a: DataFrame, b: DataFrame, columns=("i",)) -> DataFrame:
    cols = [*KEY, *columns]
    return a.select(*cols).distinct().join(b.select(*cols), cols, "left_semi")


def difference(a: DataFrame, b: DataFrame, columns=("i",)) -> DataFrame:
    cols = [*KEY, *columns]
    return a.select(*cols).distinct().join(b.select(*cols), cols, "left_anti")


def size(a: DataFrame, groups: DataFrame, columns=("i",)) -> DataFrame:
    found = a.select(*KEY, *columns).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("answer"))
    return groups.select(*KEY).join(found, KEY, "left").fillna(0, ["answer"])


def region_positions(start: Column, end: Column) -> Column:
    """``to_set`` of a region: every position, empty when start > end."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(
        F.array().cast("array<bigint>")
    )


def region_endpoints(start: Column, end: Column) -> Column:
    """What iterating, measuring or coercing a bare region sees: the two
    endpoints only.  Use ``region_positions`` for the full interval."""
    return F.array(start, end)


def in_region(i: Column, start: Column, end: Column) -> Column:
    return i.between(start, end)


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|; two empty sets agree fully."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)
