"""Sparse columns, duplicates, names, currency, imputation, display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.columns import (
    as_double,
    col,
    is_missing,
    is_text,
    mean,
    number_columns,
    require_columns,
    text_columns,
    unique_names,
)
from framewright.functions.fixed_values import MONEY_WORDS, NULL_TEXT
from framewright.functions.text import currency_from_text, normalised_name
from framewright.operators.duplicates import count_duplicates, remove_duplicates
from framewright.operators.inference import null_fractions


def sparse_columns(df: DataFrame) -> DataFrame:
    """``(column, missing_pct)`` of the columns that are more than half empty."""
    return (
        null_fractions(df)
        .filter(2 * F.col("missing_count") > F.col("row_count"))
        .orderBy("position")
        .select(
            "column",
            F.format_string("%.1f", F.col("missing_fraction") * 100).alias("missing_pct"),
        )
    )


def drop_sparse(df: DataFrame) -> DataFrame:
    """Drop columns that are more than half empty; exactly half stays."""
    dropped = {r["column"] for r in sparse_columns(df).collect()}  # one row per column
    return df.select(*[col(n) for n in df.columns if n not in dropped])


def drop_duplicates(df: DataFrame, order_key: str | None = None) -> DataFrame:
    """One of each row; missing cells equal each other.

    With ``order_key``, a column that is no part of the comparison, the first
    copy's key is kept. Rows are written once, see ``remove_duplicates``.
    """
    return remove_duplicates(df, order_key).data


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows a duplicate removal would take away."""
    return count_duplicates(df)


def normalise_names(df: DataFrame) -> DataFrame:
    """Trim, lower case, spaces to underscores; equal results are numbered."""
    return df.toDF(*unique_names([normalised_name(n) for n in df.columns]))


def strip_currency(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``$`` and ``,`` off every text column, then to number; text becomes null."""
    chosen = set(text_columns(df) if names is None else names)
    require_columns(df, chosen)
    return df.select(
        *[(currency_from_text(col(n)) if n in chosen else col(n)).alias(n) for n in df.columns]
    )


def strip_currency_by_name(df: DataFrame) -> DataFrame:
    """The same for text columns whose name speaks of money."""
    named = [n for n in text_columns(df) if any(w in n.lower() for w in MONEY_WORDS)]
    return strip_currency(df, named)


def impute_means(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become the column mean; text stays missing.

    One pass counts the gaps, one row. Columns without gaps stay as they are,
    so keys and decimals keep every digit; columns with gaps become doubles.
    Each mean is a scalar subquery; Catalyst merges them into one pass.
    """
    names = list(number_columns(df) if names is None else names)
    if not names:
        return df
    gaps = df.agg(*[F.count_if(is_missing(df, n)).alias(f"g{i}") for i, n in enumerate(names)]).first()
    means = {n: df.agg(mean(df, n)).scalar() for n, g in zip(names, gaps, strict=True) if g}
    return df.select(
        *[
            (F.coalesce(as_double(df, n), means[n]) if n in means else col(n)).alias(n)
            for n in df.columns
        ]
    )


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows whose chosen columns are all present (NaN counts as missing)."""
    require_columns(df, names)
    return df.na.drop(subset=["`" + n.replace("`", "``") + "`" for n in names])


def display_text(df: DataFrame) -> DataFrame:
    """An output projection: text and zoned times as text, dates formatted."""

    def shown(field: T.StructField):
        value = col(field.name)
        if isinstance(field.dataType, (T.TimestampNTZType, T.DateType)):
            return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        if isinstance(field.dataType, T.TimestampType) or is_text(field.dataType):
            return F.coalesce(value.cast("string"), F.lit(NULL_TEXT))
        if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            return value
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        text = F.to_json(value) if nested else value.cast("string")
        return F.coalesce(text, F.lit(NULL_TEXT))

    return df.select(*[shown(f).alias(f.name) for f in df.schema.fields])


def cleaning_report(df: DataFrame) -> DataFrame:
    """``(step, column, metric, value)``: dropped columns and removed rows."""
    return report_rows(sparse_columns(df), duplicate_count(drop_sparse(df)))


def report_rows(sparse: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Report from ``(column, missing_pct)`` and ``(duplicate_rows)``."""
    dropped = sparse.select(
        F.lit("drop_sparse").alias("step"),
        "column",
        F.lit("missing_pct").alias("metric"),
        F.col("missing_pct").alias("value"),
    )
    removed = duplicates.select(
        F.lit("drop_duplicates").alias("step"),
        F.lit(None).cast("string").alias("column"),
        F.lit("rows_removed").alias("metric"),
        F.col("duplicate_rows").cast("string").alias("value"),
    )
    return dropped.unionByName(removed)
