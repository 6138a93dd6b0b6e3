"""Rows that occur more than once, found by narrow fingerprints.

A row's fingerprint is 128 bits over all its cells. Only fingerprints are
shuffled to count them; whole rows travel where a fingerprint was seen twice,
and their equality is decided there, cell by cell. So a table with few copies
shuffles 16 bytes and a count per row, however wide its rows are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.columns import col
from framewright.session import reliable

# Repeated fingerprints that are broadcast; beyond them all rows are shuffled once.
BROADCAST_REPEATED = 1_000_000
# Cells whose nulls are marked in one number.
_MARKED = 62
_PRINTS = ["_print_1", "_print_2"]


class Deduplicated(NamedTuple):
    data: DataFrame
    removed: int


def _has_prints(data_type: T.DataType) -> bool:
    """Maps and variants have no hash; Spark compares no rows that hold them, and raises."""
    if isinstance(data_type, T.ArrayType):
        return _has_prints(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_has_prints(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def _prints(names: list[str]) -> list[Column]:
    """Two hashes with seeds of their own. Nulls, which a hash passes over, are marked by place."""
    marks = []
    for a in range(0, len(names), _MARKED):
        bits = [F.when(col(n).isNull(), F.lit(1 << i)).otherwise(0) for i, n in enumerate(names[a : a + _MARKED])]
        marks.append(sum(bits[1:], bits[0]).cast("bigint"))
    cells = [*marks, *[col(n) for n in names]]
    return [F.xxhash64(*cells).alias(_PRINTS[0]), F.xxhash64(F.lit("second"), *cells).alias(_PRINTS[1])]


def merge_equal(df: DataFrame, order_key: str | None = None) -> DataFrame:
    """One of each row by a shuffle of whole rows, equal ones merged on each task before it."""
    if order_key is None:
        return df.distinct()
    compared = [col(n) for n in df.columns if n != order_key]
    kept = df.groupBy(*compared).agg(F.min(col(order_key)).alias(order_key))
    return kept.select(*[col(n) for n in df.columns])


def _repeated(printed: DataFrame) -> tuple[DataFrame, int]:
    """Fingerprints seen more than once, written, and their number."""
    counted = printed.groupBy(*_PRINTS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*_PRINTS)
    seen = Observation()
    return reliable(counted.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]


def remove_duplicates(
    df: DataFrame, order_key: str | None = None, broadcast_repeated: int = BROADCAST_REPEATED
) -> Deduplicated:
    """One of each row, and how many were removed; missing cells equal each other.

    The rows are written once with their fingerprints; the result reads them
    from there. With ``order_key``, a column that is no part of the comparison,
    the first copy's key is kept. The rows with repeated fingerprints are
    counted while they are written.
    """
    names = [n for n in df.columns if n != order_key]
    if not names or not all(_has_prints(df.schema[n].dataType) for n in names):
        return _merged(df, order_key)
    staged = reliable(df.select(*[col(n) for n in df.columns], *_prints(names)))
    rows = staged.select(*[col(n) for n in df.columns])
    repeated, n = _repeated(staged)
    if n == 0:
        return Deduplicated(rows, 0)
    if n > broadcast_repeated:
        return _merged(rows, order_key)
    # At most ``broadcast_repeated`` rows of two numbers.
    known = F.broadcast(repeated)
    before, after = Observation(), Observation()
    copies = staged.join(known, _PRINTS, "left_semi").select(*[col(n) for n in df.columns])
    copies = copies.observe(before, F.count(F.lit(1)).alias("n"))
    merged = merge_equal(copies, order_key).observe(after, F.count(F.lit(1)).alias("n"))
    merged = reliable(merged)
    single = staged.join(known, _PRINTS, "left_anti").select(*[col(n) for n in df.columns])
    return Deduplicated(single.unionAll(merged), before.get["n"] - after.get["n"])


def _merged(df: DataFrame, order_key: str | None) -> Deduplicated:
    before, after = Observation(), Observation()
    counted = df.observe(before, F.count(F.lit(1)).alias("n"))
    merged = merge_equal(counted, order_key).observe(after, F.count(F.lit(1)).alias("n"))
    return Deduplicated(reliable(merged), before.get["n"] - after.get["n"])


def count_duplicates(df: DataFrame, broadcast_repeated: int = BROADCAST_REPEATED) -> DataFrame:
    """``(duplicate_rows)``: rows a removal would take away."""
    candidates = df
    if df.columns and all(_has_prints(f.dataType) for f in df.schema.fields):
        printed = df.select("*", *_prints(df.columns))
        repeated, n = _repeated(printed)
        if n <= broadcast_repeated:
            candidates = printed.join(F.broadcast(repeated), _PRINTS, "left_semi").drop(*_PRINTS)
    copies = candidates.groupBy(*[col(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )
