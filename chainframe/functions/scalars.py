"""Scalar functions whose meaning differs from the built-in of the same name."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def divide(a: Column, b: Column) -> Column:
    """True division; NULL on zero, to be paired with ``division_error``."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def division_error(b: Column) -> Column:
    return F.when(b == 0, F.lit("division by zero"))


def integer_power(a: Column, b: Column) -> Column:
    """int ** int stays an integer for non-negative exponents: exact decimal products, NULL where the result exceeds 64
    bits or the exponent is negative."""
    base = a.cast("decimal(19,0)")
    # Beyond 63 factors only 0, 1 and -1 stay in range, and those depend on the parity alone.
    small = F.abs(base) <= 1
    times = F.when(b <= 63, b).when(small, 2 + b % 2).cast("int")
    product = F.aggregate(
        F.sequence(F.lit(1), times), F.lit(1).cast("decimal(38,0)"),
        lambda done, _: F.try_multiply(done, base).cast("decimal(38,0)"),
    )
    return F.when(b == 0, F.lit(1).cast("long")).when(b > 0, product.try_cast("long"))


def power_error(a: Column, b: Column) -> Column:
    return F.when((b >= 0) & integer_power(a, b).isNull(), F.lit("integer overflow"))


def py_round(value: Column, digits: int = 0) -> Column:
    """Half-even rounding of the *binary* value.

    At 0 digits ``rint`` does exactly that.  Built-in ``round`` and ``bround``
    work on the shortest decimal text instead (2.675 -> 2.68), so other digits
    go through one Arrow batch call.
    """
    if digits == 0:
        return F.rint(value)
    return _round_batch(value, F.lit(digits))


@F.pandas_udf(T.DoubleType())
def _round_batch(value: pd.Series, digits: pd.Series) -> pd.Series:
    # float.__round__ rounds correctly; numpy scales and rounds instead.
    n = int(digits.iloc[0]) if len(digits) else 0
    return value.map(lambda v: v if v != v else round(float(v), n))


def fixed_text(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded on the binary value.
    ``format_string`` rounds half up on the decimal text (0.3125 -> 0.313)."""
    return _fixed_batch(value.cast("double"), F.lit(digits))


@F.pandas_udf(T.StringType())
def _fixed_batch(value: pd.Series, digits: pd.Series) -> pd.Series:
    n = int(digits.iloc[0]) if len(digits) else 0
    return value.map(lambda v: None if v != v else f"{v:.{n}f}")
