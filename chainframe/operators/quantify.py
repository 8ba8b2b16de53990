"""Quantifiers over a domain DataFrame.

A domain is any DataFrame that carries the grouping columns ``by`` (the chain
key, or the chain key plus an outer binding for nested quantifiers) and, where
order matters, the columns that define the iteration order.  Every quantifier
is one partial-then-final aggregate, so a large group is combined map-side.
``groups`` lists the groups that must appear in the result even when their
domain is empty.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY


def _complete(groups: DataFrame | None, found: DataFrame, by, name: str, empty) -> DataFrame:
    if groups is None:
        return found
    return groups.select(*by).join(found, by, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(empty))
    )


def exists(domain, predicate: Column, groups=None, by=KEY, name="answer") -> DataFrame:
    found = domain.groupBy(*by).agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias(name))
    return _complete(groups, found, by, name, False)


def forall(domain, predicate: Column, groups=None, by=KEY, name="answer") -> DataFrame:
    found = domain.groupBy(*by).agg(
        F.bool_and(F.coalesce(predicate, F.lit(False))).alias(name)
    )
    return _complete(groups, found, by, name, True)


def count(domain, predicate: Column, groups=None, by=KEY, name="answer") -> DataFrame:
    found = domain.groupBy(*by).agg(F.count_if(predicate).alias(name))
    return _complete(groups, found, by, name, 0)


def select(domain: DataFrame, predicate: Column) -> DataFrame:
    """The ``filter`` quantifier: a set stays a set of rows."""
    return domain.where(predicate)


def _extreme(domain, measure, order, where, groups, by, largest):
    rows = domain if where is None else domain.where(where)
    # NaN never wins a comparison in the measured language.
    rows = rows.withColumn("_f", measure.cast("double")).where(
        F.col("_f").isNotNull() & ~F.isnan("_f")
    )
    key = -F.col("_f") if largest else F.col("_f")
    found = rows.groupBy(*by).agg(
        F.min(F.struct(key.alias("_k"), *[F.col(c) for c in order])).alias("_best")
    )
    out = found.select(
        *by, *[F.col(f"_best.{c}").alias(c) for c in order],
        (-F.col("_best._k") if largest else F.col("_best._k")).alias("value"),
    )
    if groups is None:
        return out
    missing = F.when(F.col("value").isNull(), F.lit("empty domain")).alias("err")
    return groups.select(*by).join(out, by, "left").select("*", missing)


def argmin(domain, measure: Column, order: list[str], where=None, groups=None, by=KEY):
    """First element in iteration order with the smallest measure."""
    return _extreme(domain, measure, order, where, groups, by, False)


def argmax(domain, measure: Column, order: list[str], where=None, groups=None, by=KEY):
    return _extreme(domain, measure, order, where, groups, by, True)
