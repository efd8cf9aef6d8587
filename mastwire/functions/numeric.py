"""Small numeric expressions whose null and rounding rules follow pandas, not SQL defaults."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value on either side; a missing value stays missing, a missing bound is no bound."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often the expression names it."""
    return F.transform(F.array(value), use)[0]


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def settled(value: Column) -> Column:
    """Without the noise of summation order, so that a sum on a rounding tie is rounded alike everywhere."""
    return F.round(value, 8)


def is_true(condition: Column) -> Column:
    """A comparison with a missing side is false, never missing."""
    return F.coalesce(condition, F.lit(False))


def finite(value: Column) -> Column:
    """Present and neither NaN nor infinite."""
    return is_true(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))


def share(part: Column, whole: Column, neutral: float = 0.5) -> Column:
    """part / whole, or the neutral share when there is nothing to share."""
    return F.coalesce(F.try_divide(part, whole), F.lit(neutral))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, missing when the whole is zero or missing."""
    return F.try_divide(part, whole)


def signed_log1p(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def to_log_scale(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def from_log_scale(value: Column) -> Column:
    """Inverse of to_log_scale, guarded against overflow and never negative."""
    return F.greatest(F.expm1(clip(value, -20.0, 25.0)), F.lit(0.0))


def total(columns: list[Column]) -> Column:
    return reduce(lambda left, right: left + right, columns)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def rate_if(condition: Column, given: Column | None = None) -> Column:
    """Share of rows (of the given rows) where the condition holds."""
    flag = condition.cast("double")
    return F.avg(flag if given is None else F.when(given, flag))
