"""Small Column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    """Bound ``value``; null stays null (``least``/``greatest`` alone would skip it)."""
    return F.when(value < low, F.lit(float(low))).when(value > high, F.lit(float(high))).otherwise(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null where the denominator is zero or null."""
    return F.try_divide(numerator, F.when(denominator != 0, denominator))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over jointly defined rows; null where a side is constant.

    The built-in aggregate divides by zero there, which is an error in ANSI mode.
    """
    both_x, both_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(both_x, both_y), F.stddev_pop(both_x) * F.stddev_pop(both_y))


def defined(columns: Iterable[Column]) -> Column:
    """True where every column is non-null."""
    result = F.lit(True)
    for column in columns:
        result = result & column.isNotNull()
    return result


def stable(value: Column, digits: int = 9) -> Column:
    """Round away summation-order noise before ranking, joining or comparing."""
    return F.round(value, digits) + F.lit(0.0)


def nodata_to_null(value: Column, nodata: float) -> Column:
    """Decode a nodata marker. Compared in single precision, as layers are stored."""
    return F.when(value.cast("float") != F.lit(nodata).cast("float"), value).otherwise(F.lit(None))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def null_to_nodata(value: Column, nodata: float) -> Column:
    return F.coalesce(value, F.lit(nodata))


def half_open_category(value: Column, bounds: list[tuple[float, str]], last: str, missing: str | None) -> Column:
    """Label ``value`` by left-closed intervals ``[low, high)``.

    ``bounds`` lists (exclusive upper bound, label) in rising order; ``last``
    is used above the final bound and ``missing`` for null.
    """
    label = F.when(value.isNull(), F.lit(missing))
    for upper, name in bounds:
        label = label.when(value < upper, F.lit(name))
    return label.otherwise(F.lit(last))
