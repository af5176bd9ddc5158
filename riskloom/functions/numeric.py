"""Column expressions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low=None, high=None) -> Column:
    """Bound ``value``; null stays null although ``greatest``/``least`` skip nulls."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), bounded)


def known(value: Column) -> Column:
    """The number, or null where it is NaN: Spark would rank NaN above every number."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    number = value.cast("double")
    unusable = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~unusable, number)


def ratio_floor(numerator: Column, denominator: Column, floor: float = 1.0) -> Column:
    """``numerator / max(denominator, floor)``; cannot divide by zero."""
    return numerator / clip(denominator, floor)


def rate_or_zero(numerator: Column, denominator: Column) -> Column:
    """A quotient that is 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def total(value: Column) -> Column:
    """A sum that is 0 rather than null over no rows."""
    return F.coalesce(F.sum(value), F.lit(0.0))
