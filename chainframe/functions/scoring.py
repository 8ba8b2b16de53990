"""Comparing a predicted with a gold answer.

Both are the JSON text of the value (``0.5``, ``true``, ``[3, 9]``,
``[[1, 20], [2, 30]]``, a label) or, for predictions, free text.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from ..operators.sets import jaccard

# --- fixed values: tolerances -------------------------------------------------
INT_ABS, INT_REL = 2, 0.10
FLOAT_ABS, FLOAT_REL = 0.5, 0.05
SET_JACCARD = 0.9
# ------------------------------------------------------------------------------


def bool_match(gold: Column, pred: Column) -> Column:
    return F.coalesce(X.parse_bool(gold) == X.parse_bool(pred), F.lit(False))


def whole(number: Column) -> Column:
    """A double without its fraction.  It stays a double: a number beyond 64 bits is a wrong answer, not a failed job."""
    return number - number % 1


def int_match(gold: Column, pred: Column) -> Column:
    g, p = whole(X.parse_numeric(gold)), F.rint(X.parse_numeric(pred))
    diff = F.abs(g - p)
    near = (F.abs(g) > 0) & (F.try_divide(diff, F.abs(g)) <= INT_REL)
    return F.coalesce((diff <= INT_ABS) | near, F.lit(False))


def float_match(gold: Column, pred: Column) -> Column:
    g, p = X.parse_numeric(gold), X.parse_numeric(pred)
    diff = F.abs(g - p)
    scale = F.greatest(F.abs(g), F.abs(p), F.lit(1e-9))
    return F.coalesce((diff <= FLOAT_ABS) | (diff / scale <= FLOAT_REL), F.lit(False))


def region_match(gold: Column, pred: Column) -> Column:
    return F.coalesce(X.parse_region(gold) == X.parse_region(pred), F.lit(False))


def members(text: Column, pairs: bool) -> Column:
    """A JSON list as an array of distinct members; NULL if it is not one.  A member beyond 64 bits is NULL, which
    equals no position."""
    kind = "array<array<double>>" if pairs else "array<double>"
    parsed = F.from_json(text, kind)
    if pairs:
        return F.array_distinct(F.transform(parsed, lambda p: p.try_cast("array<bigint>")))
    return F.array_distinct(F.transform(parsed, lambda v: v.try_cast("bigint")))


def set_match(gold: Column, pred: Column, pairs: bool) -> Column:
    g, p = members(gold, pairs), members(pred, pairs)
    return F.coalesce(jaccard(g, p) >= SET_JACCARD, F.lit(False))


def label_match(gold: Column, pred: Column) -> Column:
    return F.coalesce(F.upper(F.coalesce(X.parse_label(pred), pred)) == F.upper(gold), F.lit(False))


def value_match(base: Column, gold: Column, pred: Column) -> Column:
    same = F.coalesce(X.strip(gold) == X.strip(pred), F.lit(False))
    letter = F.coalesce(F.upper(X.strip(gold)) == F.upper(X.strip(pred)), F.lit(False))
    return (
        F.when(base == "Bool", bool_match(gold, pred))
        .when(base == "Int", int_match(gold, pred))
        .when(base == "Float", float_match(gold, pred))
        .when(base == "Region", region_match(gold, pred))
        .when(base == "ResidueSet", set_match(gold, pred, False))
        .when(base == "PairSet", set_match(gold, pred, True))
        .when(base == "SecStruct", label_match(gold, pred))
        .when(base == "AAType", letter)
        .otherwise(same)
    )


def score(gold: Column, answer_type: Column, pred: Column) -> Column:
    """struct(correct, abstained_correctly, gold_unreliable, pred_unreliable,
    failure_mode)."""
    base = F.regexp_replace(answer_type, r"\|Unreliable", "")
    selective = F.contains(answer_type, F.lit("Unreliable"))
    gold_off = gold == "Unreliable"
    pred_off = X.is_unreliable(pred)
    matched = value_match(base, gold, pred)
    either = gold_off | pred_off
    return F.struct(
        F.when(selective & either, gold_off & pred_off).otherwise(matched).alias("correct"),
        F.when(selective & gold_off, pred_off).alias("abstained_correctly"),
        F.when(selective, gold_off).alias("gold_unreliable"),
        F.when(selective, pred_off).alias("pred_unreliable"),
        F.when(selective & gold_off & ~pred_off, "over_confident")
        .when(selective & ~gold_off & pred_off, "over_abstention").alias("failure_mode"),
    )


def answers_differ(a: Column, b: Column, answer_type: Column) -> Column:
    """Are two answers further apart than the scorer would forgive?"""
    base = F.regexp_replace(answer_type, r"\|Unreliable", "")
    off = (a == "Unreliable") | (b == "Unreliable")
    x, y = a.try_cast("double"), b.try_cast("double")
    diff = F.abs(x - y)
    f_rel = diff / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9))
    i, j = whole(x), whole(y)
    i_diff = F.abs(i - j)
    i_rel = i_diff / F.greatest(F.abs(i), F.abs(j), F.lit(1))
    as_set = lambda c, pairs: F.array_sort(members(c, pairs))
    return (
        F.when(off, a != b)
        .when(base == "Bool", X.parse_bool(a) != X.parse_bool(b))
        .when((base == "Float") & diff.isNotNull(), (diff >= 1e-9) & ((f_rel > 0.07) | (diff > 0.6)))
        .when((base == "Int") & i_diff.isNotNull(), (i_rel > 0.12) | (i_diff >= 3))
        .when(base == "Region", X.parse_region(a) != X.parse_region(b))
        .when(base == "ResidueSet", as_set(a, False) != as_set(b, False))
        .when(base == "PairSet", as_set(a, True) != as_set(b, True))
        .otherwise(a != b)
    )


def type_gate(value: Column, answer_type: Column) -> Column:
    """May a sampled value (JSON text) stand for an answer of this type?"""
    integer, number = value.rlike(r"^-?\d+$"), value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    return F.coalesce(
        F.when(answer_type == "Bool", value.isin("true", "false"))
        .when(answer_type == "Int", integer)
        .when(answer_type == "Float", number)
        .when(answer_type == "Region", value.rlike(r"^\[-?\d+,\s*-?\d+\]$"))
        .when(answer_type.isin("ResidueSet", "PairSet"), value.rlike(r"^\[.*\]$"))
        .when(answer_type == "SecStruct", value.isin("H", "E", "C"))
        .otherwise(value.isNotNull()),
        F.lit(False),
    )
