"""Formats of free-format date columns, decided on the shapes of their texts.

A shape is a text with every digit as 9 and every letter of a word as a; a
column of dates has few. The shapes each format can have are listed beforehand,
so one aggregate counts the shapes of all columns, and for each how many of its
texts are real dates when read year, month or day first. Formats are then
decided on those few counts; no text is held against format after format.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.columns import cells

# Formats of a free-format date column: month first where both orders fit.
FREE_DATE_FORMATS = [
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy/M/d",
    "M/d/yyyy",
    "d/M/yyyy",
    "M-d-yyyy",
    "d-M-yyyy",
    "yyyy-M-d H:m",
    "yyyy-M-d H:m:s.SSS",
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s.SSS",
    "yyyy-M-d'T'H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d'T'H:m:s.SSS'Z'",
    "yyyy-M-d'T'H:m:s.SSSSSS'Z'",
    "M/d/yyyy H:m",
    "M/d/yyyy H:m:s",
    "d/M/yyyy H:m",
    "d/M/yyyy H:m:s",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
]

# The names of the months.
MONTHS = (
    "January February March April May June July August September October November December".split()
)

_DIGITS = "0123456789"
# T and Z are no part of a month's name and stand for themselves in formats.
_LETTERS = "ABCDEFGHIJKLMNOPQRSUVWXYabcdefghijklmnopqrstuvwxyz"
_SHAPES = {
    "yyyy": ["9999"],
    "MMMM": sorted({"a" * len(m) for m in MONTHS}),
    "MMM": ["aaa"],
    **{part: ["9", "99"] for part in ("M", "d", "H", "m", "s")},
    "SSSSSS": ["999999"],
    "SSS": ["999"],
}
# The longest text any format can have.
_LONGEST = 32


def _shapes(date_format: str) -> set[str]:
    """Every shape a text of the format can have."""
    parts = [m[0] for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", date_format)]
    return {"".join(s) for s in itertools.product(*[_SHAPES.get(p, [p.strip("'")]) for p in parts])}


SHAPES_OF = {f: _shapes(f) for f in FREE_DATE_FORMATS}
_ALL_SHAPES = sorted(set().union(*SHAPES_OF.values()))


def _order(date_format: str) -> str:
    """Which reading of the text a format goes by."""
    if "MMM" in date_format:
        return "full" if "MMMM" in date_format else "short"
    return {"y": "year", "M": "month", "d": "day"}[date_format[0]]


def shape(text: Column) -> Column:
    """The shape of a text, null where no format can have it."""
    masked = F.translate(text, _DIGITS + _LETTERS, "9" * len(_DIGITS) + "a" * len(_LETTERS))
    return F.when((F.octet_length(text) <= _LONGEST) & masked.isin(_ALL_SHAPES), masked)


def _valid_day(year: Column, month: Column, day: Column) -> Column:
    """Whether the numbers are a day of the calendar, by the lengths of the months."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    length = (
        F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    )
    return month.between(1, 12) & (day >= 1) & (day <= length)


def _readings(part: Sequence[Column], word: Column) -> dict[str, Column]:
    """Whether a text's numbers, and its word, are a date in each order; every part's range is checked."""
    hour, minute, second = part[3:6]
    in_day = (
        F.coalesce(hour < 24, F.lit(True)) & F.coalesce(minute < 60, F.lit(True)) & F.coalesce(second < 60, F.lit(True))
    )

    def month_of(names: list[str]) -> Column:
        return F.array_position(F.array(*[F.lit(m) for m in names]), word).cast("int")

    return {
        "year": _valid_day(part[0], part[1], part[2]) & in_day,
        "month": _valid_day(part[2], part[0], part[1]) & in_day,
        "day": _valid_day(part[2], part[1], part[0]) & in_day,
        # Texts with a month's name hold a day and a year, in this order.
        "short": (word != "") & _valid_day(part[1], month_of([m[:3] for m in MONTHS]), part[0]),
        "full": (word != "") & _valid_day(part[1], month_of(MONTHS), part[0]),
    }


def shape_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, shape, texts, year, month, day, short, full): texts of each shape, and dates among them.

    Shapes that no format can have count as one, null. So a column has a
    bounded number of rows, and counts are combined on each task.
    """
    held = cells(df, list(names)).filter(F.col("cell").isNotNull())
    shaped = held.withColumn("shape", shape(F.col("cell")))
    known = F.when(F.col("shape").isNotNull(), F.col("cell"))
    split = shaped.select(
        "column",
        "shape",
        F.regexp_extract_all(known, F.lit(r"\d+"), F.lit(0)).alias("numbers"),
        F.regexp_extract(known, "[A-Za-z]+", 0).alias("word"),
    )
    names = [f"n{i}" for i in range(6)]
    parts = split.select(
        "column", "shape", "word", *[F.get("numbers", F.lit(i)).cast("int").alias(n) for i, n in enumerate(names)]
    )
    readings = _readings([F.col(n) for n in names], F.col("word"))
    return parts.groupBy("column", "shape").agg(
        F.count(F.lit(1)).alias("texts"),
        *[F.count_if(valid).alias(order) for order, valid in readings.items()],
    )


def free_formats(df: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
    """The first free format that every text of a column fits, for all columns by one aggregate."""
    found: dict[str, list] = {n: [] for n in names}
    for row in shape_counts(df, names).collect() if names else []:
        found[row["column"]].append(row)

    def fits(rows: list, date_format: str) -> bool:
        order, shapes = _order(date_format), SHAPES_OF[date_format]
        return all(r["shape"] in shapes and r[order] == r["texts"] for r in rows)

    return {n: next((f for f in FREE_DATE_FORMATS if fits(rows, f)), None) for n, rows in found.items()}
