"""The sales report: totals, best categories, months."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.columns import col, mean, number_columns, total
from framewright.functions.fixed_values import (
    CATEGORY_NAME,
    DATE_WORD,
    SALES_WORDS,
    TOP_CATEGORIES,
)
from framewright.functions.text import money
from framewright.operators.cleaning import impute_means, strip_currency_by_name
from framewright.operators.inference import parse_dates


@dataclass
class SalesReport:
    """The tables of the report, each built when it is first asked for."""

    cleaned: DataFrame
    sales: str
    category: str | None
    date: str | None

    @cached_property
    def totals(self) -> DataFrame:
        return sales_totals(self.cleaned, self.sales)

    @cached_property
    def top_categories(self) -> DataFrame | None:
        return top_categories(self.cleaned, self.category, self.sales) if self.category else None

    @cached_property
    def monthly(self) -> DataFrame | None:
        """The date column's texts are looked at here, by one job."""
        return monthly_sales(self.cleaned, self.date, self.sales) if self.date else None


def clean_sales(df: DataFrame) -> DataFrame:
    """Money columns to numbers, then missing numbers to the column mean."""
    return impute_means(strip_currency_by_name(df))


def sales_column(df: DataFrame) -> str:
    for name in number_columns(df):
        if any(w in name.lower() for w in SALES_WORDS):
            return name
    raise ValueError("no numeric column speaks of sales or revenue")


def category_column(df: DataFrame) -> str | None:
    return next((n for n in df.columns if n.lower() == CATEGORY_NAME), None)


def date_column(df: DataFrame) -> str | None:
    return next((n for n in df.columns if DATE_WORD in n.lower()), None)


def sales_totals(df: DataFrame, sales: str | None = None) -> DataFrame:
    """One row ``(total_sales, average_sales)`` of a cleaned frame."""
    sales = sales or sales_column(df)
    return df.agg(total(df, sales).alias("total_sales"), mean(df, sales).alias("average_sales"))


def top_categories(
    df: DataFrame, category: str, sales: str | None = None, top: int = TOP_CATEGORIES
) -> DataFrame:
    sales = sales or sales_column(df)
    return (
        df.filter(col(category).isNotNull())
        .groupBy(col(category).alias("category"))
        .agg(total(df, sales).alias("total_sales"))
        .orderBy(F.desc("total_sales"), "category")
        .limit(top)
    )


def monthly_sales(df: DataFrame, date: str, sales: str | None = None) -> DataFrame:
    """``(month, total_sales)`` in month order; rows without a date are out."""
    sales = sales or sales_column(df)
    dated = parse_dates(df, date).filter(col(date).isNotNull())
    return (
        dated.groupBy(F.date_format(col(date), "yyyy-MM").alias("month"))
        .agg(total(df, sales).alias("total_sales"))
        .orderBy("month")
    )


def sales_report(df: DataFrame) -> SalesReport:
    """Clean the frame and find the columns by name."""
    cleaned = clean_sales(df)
    return SalesReport(cleaned, sales_column(cleaned), category_column(cleaned), date_column(cleaned))


def totals_text(totals: DataFrame) -> DataFrame:
    """The totals as currency text."""
    return totals.select(*[money(col(n)).alias(n) for n in totals.columns])
