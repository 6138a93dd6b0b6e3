"""Type inference on text columns: one evidence pass, then one typed projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.columns import cells, col, is_missing, per_column, text_columns
from framewright.functions.fixed_values import (
    DATE_FORMATS,
    FALSE_TOKENS,
    JSON_DATE_NAMES,
    JSON_DATE_PREFIXES,
    JSON_DATE_SUFFIXES,
    JSON_MIN_EPOCH,
    TRUE_TOKENS,
)
from framewright.functions.text import (
    date_from_text,
    fits_date,
    flag_from_text,
    integer_from_text,
    number_from_text,
)
from framewright.operators.date_shapes import free_formats

# How texts of a date format begin. A text begins in one way at most, so it is
# only held against the formats of its own family.
DATE_FAMILIES = {"y-": r"^\d{4}-", "y/": r"^\d{4}/", "d/": r"^\d{1,2}/", "d-": r"^\d{1,2}-"}

@dataclass(frozen=True)
class ColumnType:
    """What becomes of one text column."""

    column: str
    kind: str  # text, bigint, double, boolean, flag_number, timestamp
    date_format: str | None = None


def null_fractions(df: DataFrame) -> DataFrame:
    """``(position, column, row_count, missing_count, missing_fraction)``."""

    def metrics(name: str) -> dict[str, Column]:
        missing = F.count_if(is_missing(df, name))
        rows = F.count(F.lit(1))
        return {
            "row_count": rows,
            "missing_count": missing,
            "missing_fraction": F.try_divide(missing, rows),
        }

    return per_column(df, df.columns, metrics)


def type_evidence(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per text column with all the counts the type rules need.

    Cells are read once, in long form, so the plan does not grow with the
    number of columns; counts combine on each task before the shuffle.
    """
    names = list(names or text_columns(df))
    cell, number = F.col("cell"), F.col("number")
    family = F.lit(None).cast("string")
    for label, start in DATE_FAMILIES.items():
        family = F.when(cell.rlike(start), label).otherwise(family)
    read = cells(df, names).select(
        "column",
        "cell",
        number_from_text(cell).isNotNull().alias("number"),
        family.alias("family"),
    )
    counts = [
        F.count(F.lit(1)).alias("row_count"),
        F.count(cell).alias("present"),
        F.count_if(number).alias("numbers"),
        F.count_if(number & integer_from_text(cell).isNotNull()).alias("integers"),
        F.count_if(~number & cell.isin([*TRUE_TOKENS, *FALSE_TOKENS])).alias("flags"),
    ]
    for i, (prefix, spark_format) in enumerate(DATE_FORMATS):
        own = F.col("family") == _family(spark_format)
        counts.append(F.count_if(own & cell.rlike(f"^{prefix}")).alias(f"matched_{i}"))
        counts.append(F.count_if(own & fits_date(cell, spark_format)).alias(f"parsed_{i}"))
    return read.groupBy("column").agg(*counts)


def _family(spark_format: str) -> str:
    return ("y" if spark_format.startswith("yyyy") else "d") + ("/" if "/" in spark_format else "-")


def _date_format(e: Row) -> str | None:
    """First format that most cells look like and every cell parses as."""
    for i, (_, spark_format) in enumerate(DATE_FORMATS):
        likely = 5 * e[f"matched_{i}"] > 4 * e["present"]
        if likely and e[f"parsed_{i}"] == e["present"]:
            return spark_format
    return None


def decide_type(e: Row, raw_text: bool) -> ColumnType:
    """Type rules on the counts of one column.

    ``raw_text`` says that the source itself knows no types: a column whose
    present cells are all numbers (or all flags) is typed whatever its nulls.
    Otherwise more than 80 % of all rows must be numbers, nulls included.
    """
    name, rows, present = e["column"], e["row_count"], e["present"]
    mostly = 5 * e["numbers"] > 4 * rows
    if mostly or (raw_text and present and e["numbers"] == present):
        whole = e["integers"] == rows
        return ColumnType(name, "bigint" if whole else "double")
    if raw_text and present and e["flags"] == present:
        if present == rows:
            return ColumnType(name, "boolean")
        return ColumnType(name, "flag_number" if 5 * e["flags"] > 4 * rows else "text")
    if e["numbers"] == 0 and present:
        found = _date_format(e)
        if found:
            return ColumnType(name, "timestamp", found)
    return ColumnType(name, "text")


def typed(value: Column, decision: ColumnType) -> Column:
    if decision.kind == "bigint":
        return integer_from_text(value)
    if decision.kind == "double":
        return number_from_text(value)
    if decision.kind == "boolean":
        return flag_from_text(value)
    if decision.kind == "flag_number":
        return flag_from_text(value).cast("int").cast("double")
    if decision.kind == "timestamp":
        return date_from_text(value, decision.date_format)
    return value


def apply_types(df: DataFrame, decisions: Sequence[ColumnType]) -> DataFrame:
    """One projection; columns without a decision stay as they are."""
    by_name = {d.column: d for d in decisions}
    return df.select(
        *[
            (typed(col(n), by_name[n]) if n in by_name else col(n)).alias(n)
            for n in df.columns
        ]
    )


def infer_types(
    df: DataFrame, raw_text: bool = False, names: Sequence[str] | None = None
) -> tuple[DataFrame, list[ColumnType]]:
    """Typed frame and the decisions behind it; one aggregate runs."""
    names = list(names or text_columns(df))
    if not names:
        return df, []
    # One short row of counts per column.
    evidence = {r["column"]: r for r in type_evidence(df, names).collect()}
    decisions = [decide_type(evidence[n], raw_text) for n in names if n in evidence]
    return apply_types(df, decisions), decisions


def parse_dates(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Turn date columns of unknown format into timestamps; bad values raise.

    One aggregate looks at the texts of all columns.
    """
    names = [names] if isinstance(names, str) else list(names)
    texts = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    found = free_formats(df, texts)
    if None in found.values():
        lost = ", ".join(n for n, f in found.items() if f is None)
        raise ValueError(f"no date format fits every value of column {lost}")

    def dated(name: str) -> Column:
        if name in found:
            return date_from_text(col(name), found[name])
        return col(name).cast("timestamp_ntz") if name in names else col(name)

    return df.select(*[dated(n).alias(n) for n in df.columns])


def _is_json_date(name: str) -> bool:
    lowered = name.lower()
    return (
        lowered in JSON_DATE_NAMES
        or any(lowered.endswith(s) for s in JSON_DATE_SUFFIXES)
        or any(lowered.startswith(p) for p in JSON_DATE_PREFIXES)
    )


def json_types(df: DataFrame) -> DataFrame:
    """What a JSON reader does beyond JSON's own types.

    Text columns that hold only numbers become numeric; columns with a date
    name become timestamps if all their texts are dates or all their numbers
    are epochs (seconds, milliseconds, microseconds or nanoseconds).
    """
    names = text_columns(df)
    evidence = {r["column"]: r for r in type_evidence(df, names).collect()} if names else {}
    decisions, loose = [], []
    for n, e in evidence.items():
        if e["present"] and e["numbers"] == e["present"]:
            decisions.append(decide_type(e, raw_text=True))
        elif _is_json_date(n) and e["present"]:
            fitting = [
                f for i, (_, f) in enumerate(DATE_FORMATS) if e[f"parsed_{i}"] == e["present"]
            ]
            if fitting:
                decisions.append(ColumnType(n, "timestamp", fitting[0]))
            else:
                loose.append(n)
    df = apply_types(df, decisions)
    found = {n: f for n, f in free_formats(df, loose).items() if f}
    df = df.withColumns({n: date_from_text(col(n), f) for n, f in found.items()}) if found else df
    epochs = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and _is_json_date(f.name)
    ]
    if not epochs:
        return df
    ranges = {
        r["column"]: r
        for r in per_column(
            df,
            epochs,
            lambda n: {
                "low": F.min(col(n)).cast("double"),
                "high": F.max(col(n)).cast("double"),
            },
        ).collect()
    }
    changes = {}
    for n in epochs:
        low, high = ranges[n]["low"], ranges[n]["high"]
        if low is None or low <= JSON_MIN_EPOCH:
            continue
        # The first unit whose dates fit a 64-bit count of nanoseconds.
        unit = next((u for u in (1, 1_000, 1_000_000) if high / u < 2**63 / 1e9), 1_000_000_000)
        seconds = (col(n).cast("double") / unit).cast("decimal(18,6)")
        zero = F.lit(0)
        # Added to the epoch, so the session's time zone plays no part.
        changes[n] = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
            zero, zero, zero, seconds
        )
    return df.withColumns(changes) if changes else df
