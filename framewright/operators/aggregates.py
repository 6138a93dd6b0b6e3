"""The aggregate menu of structured queries; missing cells are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.columns import as_double, col, is_missing, is_text, mean, require_numbers


def _value(df: DataFrame, name: str) -> Column:
    """The column itself, NaN as null."""
    return F.when(~is_missing(df, name), col(name))


def _sum(df: DataFrame, name: str, order: Column | None) -> Column:
    value = _value(df, name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        value = value.cast("bigint")
    return F.coalesce(F.sum(value), F.lit(0))


def _mean(df, name, order):
    return mean(df, name)


def _count(df, name, order):
    return F.count(_value(df, name))


def _min(df, name, order):
    return F.min(_value(df, name))


def _max(df, name, order):
    return F.max(_value(df, name))


def _std(df, name, order):
    return F.stddev_samp(as_double(df, name))


def _var(df, name, order):
    return F.var_samp(as_double(df, name))


def _nunique(df, name, order):
    return F.count_distinct(_value(df, name))


def _size(df, name, order):
    return F.count(F.lit(1))


def _ordered(pick: Callable, df: DataFrame, name: str, order: Column | None) -> Column:
    """The value at the end of an order key that is unique within its group."""
    if order is None:
        raise ValueError("first and last need order_by: rows have no order of their own")
    value = _value(df, name)
    # A missing cell has no rank, so it is never picked.
    return pick(value, F.when(value.isNotNull(), order))


def _first(df, name, order):
    return _ordered(F.min_by, df, name, order)


def _last(df, name, order):
    return _ordered(F.max_by, df, name, order)


def _prod(df, name, order):
    return F.coalesce(F.product(as_double(df, name)), F.lit(1.0))


def _truth(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.BooleanType):
        return col(name)
    if is_text(data_type):
        return col(name) != ""
    return as_double(df, name) != 0


def _any(df, name, order):
    return F.coalesce(F.bool_or(_truth(df, name)), F.lit(False))


def _all(df, name, order):
    return F.coalesce(F.bool_and(_truth(df, name)), F.lit(True))


def _sem(df, name, order):
    value = as_double(df, name)
    return F.stddev_samp(value) / F.sqrt(F.nullif(F.count(value), F.lit(0)))


def _skew(df, name, order):
    """Sample skewness: 0 for equal values, null below three values."""
    value = as_double(df, name)
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.when(F.var_pop(value) == 0, F.lit(0.0)).otherwise(corrected))


AGGREGATES: dict[str, Callable[[DataFrame, str, Column | None], Column]] = {
    "sum": _sum,
    "mean": _mean,
    "count": _count,
    "min": _min,
    "max": _max,
    "std": _std,
    "var": _var,
    "nunique": _nunique,
    "size": _size,
    "first": _first,
    "last": _last,
    "prod": _prod,
    "any": _any,
    "all": _all,
    "sem": _sem,
    "skew": _skew,
}

# Built in operators/medians.py, because large groups need several passes.
MEDIAN = "median"

NUMBERS_ONLY = {"sum", "mean", "median", "std", "var", "prod", "sem", "skew"}


def check_aggregate(df: DataFrame, name: str, columns: list[str]) -> None:
    if name != MEDIAN and name not in AGGREGATES:
        menu = ", ".join([*AGGREGATES, MEDIAN])
        raise ValueError(f"unknown aggregate {name!r}; the menu is {menu}")
    if name in NUMBERS_ONLY:
        require_numbers(df, columns, name)


def aggregate_column(
    df: DataFrame, function: str, name: str, order_by: str | None = None
) -> Column:
    order = col(order_by) if order_by else None
    return AGGREGATES[function](df, name, order).alias(name)
