"""Exact medians that never hold an unbounded group in one task.

Few groups are bracketed by a sketch, and only values inside the brackets are
counted and written. Otherwise values are counted per group: equal values
merge on each task, and the shuffle spreads a group over its values. Groups
with few counted values are ranked by a window per group; else the counts are
range-partitioned by group and value, so that a large group covers many
partitions, and only the partition that holds the middle is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.columns import as_double, col
from framewright.session import reliable

# Groups that are bracketed; half the width of a bracket as a share of the values; sketch accuracy
# (rank error 1 / ACCURACY, well within the bracket).
BRACKETED_GROUPS = 1_000
MARGIN, ACCURACY = 0.002, 5_000
# Most distinct values of one group that a single task may rank.
RANKED_VALUES = 2_000_000

_COLUMN, _VALUE = "_column", "_value"


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    ranked_values: int = RANKED_VALUES,
) -> DataFrame:
    """``keys`` and the exact median of each value column, nulls skipped.

    Keys must not be null; groups without any value have null medians.
    """
    mark = "_median_of"
    while any(c.startswith(mark) for c in df.columns):
        mark = f"_{mark}"
    names = {f"{mark}_{i}": v for i, v in enumerate(values)}
    rows = df.select(
        *[col(k) for k in keys], *[as_double(df, v).alias(n) for n, v in names.items()]
    )
    long = rows.unpivot([col(k) for k in keys], list(names), _COLUMN, _VALUE)
    medians = _medians(long, [*keys, _COLUMN], ranked_values)
    return medians.groupBy(*[col(k) for k in keys]).agg(
        *[F.max(F.when(F.col(_COLUMN) == n, F.col("_median"))).alias(v) for n, v in names.items()]
    )


def column_medians(
    df: DataFrame, values: Sequence[str], ranked_values: int = RANKED_VALUES
) -> DataFrame:
    """``(column, median)`` of whole columns: the columns are the groups."""
    long = df.select(*[as_double(df, v).alias(v) for v in values]).unpivot(
        [], [col(v) for v in values], "column", _VALUE
    )
    return _medians(long, ["column"], ranked_values, few=True).withColumnRenamed("_median", "median")


def _medians(long: DataFrame, keys: Sequence[str], ranked_values: int, few: bool = False) -> DataFrame:
    """Medians of the long form; ``few`` says that the groups are known to be few.

    Few groups are bracketed: one scan of sketches with a known rank error
    gives two values around each median, a second scan counts what lies below
    them and keeps what lies between, and only that is written and ranked. Very
    many groups are shuffled by value instead, since their brackets would not
    fit a broadcast.
    """
    groups = [col(k) for k in keys]
    if not few:
        about = long.agg(F.approx_count_distinct(F.struct(*groups))).first()[0]
        few = about <= BRACKETED_GROUPS
    counts, totals = _bracketed(long, keys) if few else (None, None)
    if counts is None:
        # A missing value counts no copies, but keeps its group in the result.
        counts = reliable(long.groupBy(*groups, _VALUE).agg(F.count(_VALUE).alias("_copies")))
        totals = counts.groupBy(*groups).agg(F.sum("_copies").alias("_n"), F.lit(0).alias("_below"))
        placed = counts.withColumns(
            {"_n": F.sum("_copies").over(Window.partitionBy(*groups)), "_below": F.lit(0)}
        )
    else:
        placed = counts
    largest = counts.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= ranked_values:
        ranked = _ranked(placed, groups, F.col("_below"))
    else:
        ranked = _ranked_by_ranges(counts.select(*groups, _VALUE, "_copies"), totals, keys)
    low, high = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") < rank) & (rank <= F.col("_upto")), F.col(_VALUE)))

    found = ranked.groupBy(*groups).agg(((value_at(low) + value_at(high)) / 2).alias("_median"))
    if not few:
        return found
    # Groups without any value have no row between the brackets.
    return totals.select(*groups).join(found, list(keys), "left")


def _bracketed(long: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Counts of the values around each median with ``_n`` and ``_below``, and these per group.

    None if a bracket misses its median, which the sketch's error rules out.
    """
    groups = [col(k) for k in keys]
    ends = F.percentile_approx(_VALUE, [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)
    brackets = reliable(
        long.groupBy(*groups).agg(F.count(_VALUE).alias("_n"), ends.alias("_ends"))
    )
    # At most BRACKETED_GROUPS rows, or one per column.
    named = brackets.select(*[col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], "_ends")
    same = [col(k) == F.col(f"_of_{i}") for i, k in enumerate(keys)]
    beside = long.filter(F.col(_VALUE).isNotNull()).join(F.broadcast(named), same)
    inside = F.when(F.col(_VALUE) >= F.col("_ends")[0], F.col(_VALUE))
    counts = reliable(
        beside.filter(F.col(_VALUE) <= F.col("_ends")[1])
        .groupBy(*groups, inside.alias(_VALUE))
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    sides = counts.groupBy(*groups).agg(
        F.sum(F.when(F.col(_VALUE).isNull(), F.col("_copies"))).alias("_low"),
        F.sum(F.when(F.col(_VALUE).isNotNull(), F.col("_copies"))).alias("_kept"),
    )
    below = F.coalesce("_low", F.lit(0))
    totals = reliable(
        brackets.join(sides, list(keys), "left").select(
            *groups, "_n", below.alias("_below"), F.coalesce("_kept", F.lit(0)).alias("_kept")
        )
    )
    missed = totals.filter("_n > 0 and (_below >= (_n + 1) div 2 or _below + _kept < _n div 2 + 1)")
    if missed.head(1):
        return None, None
    kept = counts.filter(F.col(_VALUE).isNotNull())
    return kept.join(F.broadcast(totals.drop("_kept")), list(keys)), totals


def _ranked(counts: DataFrame, within: Sequence[Column], start: Column) -> DataFrame:
    """Counts with the ranks each value covers: after ``_from``, up to ``_upto``."""
    running = F.sum("_copies").over(Window.partitionBy(*within).orderBy(F.col(_VALUE).asc_nulls_first()))
    return counts.withColumn("_upto", start + running).withColumn(
        "_from", F.col("_upto") - F.col("_copies")
    )


def _ranked_by_ranges(counts: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranks around the middle of every group; other values are left out."""
    groups = [col(k) for k in keys]
    placed = reliable(
        counts.repartitionByRange(*groups, _VALUE).withColumn("_part", F.spark_partition_id())
    )
    # At most one row per group and partition.
    parts = placed.groupBy(*groups, "_part").agg(F.sum("_copies").alias("_size"))
    parts = parts.join(totals.select(*groups, "_n", "_below"), list(keys))
    before = F.sum("_size").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_size")
    parts = parts.withColumn("_start", F.col("_below") + before)
    low, high = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")
    middle = parts.filter(
        (F.col("_start") < high) & (F.col("_start") + F.col("_size") >= low) | (F.col("_n") == 0)
    ).drop("_size", "_below")
    inside = placed.alias("r").join(
        middle.alias("m"),
        [F.col(f"r.`{k}`") == F.col(f"m.`{k}`") for k in [*keys, "_part"]],
    )
    inside = inside.select("r.*", "m._n", "m._start")
    return _ranked(inside, [*groups, F.col("_part")], F.col("_start"))
