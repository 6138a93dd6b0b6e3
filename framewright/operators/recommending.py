"""Chart recommendations: rules over the column profiles of many tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.fixed_values import (
    BAR_CATEGORIES_BELOW,
    GENERIC_CHARTS,
    HISTOGRAM_COLUMNS,
    ROLE_CHARTS,
)
from framewright.operators.querying import ChartSpec

# Texts of the recommendations (fixed values); {0} and {1} are column names.
DISTRIBUTION = ("Distribution of {0}", "Shows how {0} values are distributed")
GENERIC_TREND = ("{0} Over Time", "Shows {0} trends over time")
GENERIC_BARS = ("{0} by {1}", "Compares {0} across categories")
ROLE_TREND = ("{0} Over Time", "Shows how {0} changes over time")
ROLE_BARS = ("{0} by {1}", "Compares {0} across different {1} categories")
ROLE_SCATTER = ("Relationship: {0} vs {1}", "Shows relationship between {0} and {1}")


def _filled(template: str, first: Column, second: Column) -> Column:
    text = F.lit(template)
    for mark, value in (("{0}", first), ("{1}", second)):
        text = F.replace(text, F.lit(mark), value)
    return text


def _chart(texts: tuple[str, str], plot: str, first: Column, second: Column | None, columns: list[Column]) -> Column:
    other = F.lit("") if second is None else second
    return F.struct(
        _filled(texts[0], first, other).alias("title"),
        F.lit(plot).alias("plot_type"),
        F.array(*columns).alias("columns"),
        _filled(texts[1], first, other).alias("explanation"),
    )


def _by_table(roles: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """One row per table: for each wanted role the columns in table order."""
    entry = F.struct("position", "column", "distinct_count")
    lists = [
        F.array_sort(F.collect_list(F.when(condition, entry))).alias(name)
        for name, condition in wanted.items()
    ]
    # A group holds one row per column of a table.
    return roles.groupBy("table_name").agg(F.max("row_count").alias("row_count"), *lists)


def _nth(name: str, i: int) -> Column:
    return F.get(F.col(name), F.lit(i))["column"]


def _ranked(tables: DataFrame, candidates: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` candidates of each table that apply, in order."""
    kept = F.slice(F.filter(F.array(*candidates), lambda c: c.isNotNull()), 1, limit)
    chosen = tables.select("table_name", F.posexplode(kept).alias("place", "chart"))
    return chosen.select("table_name", (F.col("place") + 1).alias("rank"), "chart.*")


def recommend_generic(roles: DataFrame) -> DataFrame:
    """``(table_name, rank, title, plot_type, columns, explanation)``.

    Histograms of the first three numeric columns, a line of the first
    datetime and numeric column, bars of the first text and numeric column
    where the text has few values; at most five. Empty tables get none.
    """
    is_flag = F.col("dtype") == "boolean"
    tables = _by_table(
        roles,
        {
            "numbers": (F.col("role") == "numeric") & ~is_flag,
            "dates": F.col("role") == "datetime",
            "texts": F.col("dtype") == "string",
        },
    ).filter(F.col("row_count") > 0)
    number, date, text = _nth("numbers", 0), _nth("dates", 0), _nth("texts", 0)
    few = F.get("texts", F.lit(0))["distinct_count"] < BAR_CATEGORIES_BELOW
    candidates = [
        F.when(
            _nth("numbers", i).isNotNull(),
            _chart(DISTRIBUTION, "histogram", _nth("numbers", i), None, [_nth("numbers", i)]),
        )
        for i in range(HISTOGRAM_COLUMNS)
    ]
    candidates.append(
        F.when(
            date.isNotNull() & number.isNotNull(),
            _chart(GENERIC_TREND, "line", number, None, [date, number]),
        )
    )
    candidates.append(
        F.when(
            text.isNotNull() & number.isNotNull() & few,
            _chart(GENERIC_BARS, "bar", number, text, [text, number]),
        )
    )
    return _ranked(tables, candidates, GENERIC_CHARTS)


def recommend_by_role(roles: DataFrame) -> DataFrame:
    """A histogram, then one of line, bar or scatter, filled up with histograms.

    Filling starts at the numeric column whose place equals the number of
    charts so far.
    """
    tables = _by_table(
        roles,
        {
            "numbers": F.col("role") == "numeric",
            "dates": F.col("role") == "datetime",
            "categories": F.col("role") == "categorical",
        },
    )
    first, second = _nth("numbers", 0), _nth("numbers", 1)
    date, category = _nth("dates", 0), _nth("categories", 0)

    def distribution(i: int) -> Column:
        name = _nth("numbers", i)
        return F.when(name.isNotNull(), _chart(DISTRIBUTION, "histogram", name, None, [name]))

    pair = F.when(
        first.isNotNull(),
        F.when(date.isNotNull(), _chart(ROLE_TREND, "line", first, None, [date, first]))
        .when(category.isNotNull(), _chart(ROLE_BARS, "bar", first, category, [category, first]))
        .when(second.isNotNull(), _chart(ROLE_SCATTER, "scatter", first, second, [first, second])),
    )
    # Without a pair there is only one numeric column, so filling starts at 2.
    filling = [distribution(i) for i in range(2, ROLE_CHARTS)]
    return _ranked(tables, [distribution(0), pair, *filling], ROLE_CHARTS)


def recommend_fallback(roles: DataFrame) -> DataFrame:
    """A histogram of the first numeric column; flags are left out."""
    tables = _by_table(
        roles, {"numbers": (F.col("role") == "numeric") & (F.col("dtype") != "boolean")}
    )
    name = _nth("numbers", 0)
    chart = F.when(name.isNotNull(), _chart(DISTRIBUTION, "histogram", name, None, [name]))
    return _ranked(tables, [chart], 1)


def specs_of(recommendations: DataFrame, table_name: str = "") -> list[ChartSpec]:
    """The few recommendations of one table as chart specs."""
    rows = (
        recommendations.filter(F.col("table_name") == table_name).orderBy("rank").collect()
    )
    return [ChartSpec(r["title"], r["plot_type"], list(r["columns"]), r["explanation"]) for r in rows]
