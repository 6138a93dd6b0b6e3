"""The table behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.columns import (
    as_double,
    col,
    is_datetime,
    mean,
    number_columns,
    require_columns,
    require_numbers,
    total,
)
from framewright.functions.fixed_values import HISTOGRAM_BINS, TOP_VALUES
from framewright.operators.cleaning import drop_missing
from framewright.operators.querying import ChartSpec


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(bin, low, high, count)``, equal widths, the last bin closed on the right.

    Two passes over one column: the range (a scalar subquery), then counts that
    combine per task into ``bins`` rows. Empty bins are kept; missing values
    are left out; an infinite value raises.
    """
    require_columns(df, [column])
    require_numbers(df, [column], "histogram")
    number = as_double(df, column)
    refused = F.raise_error(F.lit(f"column {column} holds infinite values")).cast("double")
    values = df.select(
        F.when(F.abs(number) == F.lit(float("inf")), refused).otherwise(number).alias("x")
    ).filter(F.col("x").isNotNull())
    flat = F.min("x") == F.max("x")
    ends = values.agg(
        F.struct(
            F.when(flat, F.min("x") - 0.5).otherwise(F.min("x")).alias("lo"),
            F.when(flat, F.max("x") + 0.5).otherwise(F.max("x")).alias("hi"),
        ).alias("ends")
    ).scalar()
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, hi).otherwise(lo + i * width)

    guess = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
    # Division may round across an edge; the edges themselves decide.
    placed = values.select("x", guess.alias("g")).select(
        F.when(F.col("x") < edge(F.col("g")), F.col("g") - 1)
        .when((F.col("g") < bins - 1) & (F.col("x") >= edge(F.col("g") + 1)), F.col("g") + 1)
        .otherwise(F.col("g"))
        .alias("b")
    )
    counts = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # The right side has at most `bins` rows.
    return all_bins.join(F.broadcast(counts), F.col("bin") == F.col("b"), "left").select(
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def category_means(df: DataFrame, category: str, value: str) -> DataFrame:
    """Mean of the value per category, sorted; empty categories and means are out."""
    require_columns(df, [category, value])
    require_numbers(df, [value], "bar chart")
    means = (
        drop_missing(df, [category])
        .groupBy(col(category))
        .agg(mean(df, value).alias("mean"))
    )
    return means.filter(F.col("mean").isNotNull()).orderBy(col(category))


def category_means_and_counts(df: DataFrame, category: str, value: str) -> DataFrame:
    require_columns(df, [category, value])
    require_numbers(df, [value], "bar chart")
    number = as_double(df, value)
    return (
        drop_missing(df, [category])
        .groupBy(col(category))
        .agg(mean(df, value).alias("mean"), F.count(number).alias("count"))
        .orderBy(col(category))
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Frequency of each value, most frequent first, ties by value."""
    require_columns(df, [column])
    counts = (
        drop_missing(df, [column]).groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))
    )
    ordered = counts.orderBy(F.desc("count"), col(column))
    return ordered.limit(top) if top is not None else ordered


def top_values(df: DataFrame, column: str, top: int = TOP_VALUES) -> DataFrame:
    return value_counts(df, column, top)


def time_series(
    df: DataFrame, time: str, value: str, bucket: str | None = None, pixels: int | None = None
) -> DataFrame:
    """Rows in time order, none merged; rows without time or value are out.

    The order ends in a row number, so that rows sharing one time can be split
    over several partitions. ``bucket`` (``hour``, ``day``, ``month`` ...)
    gives the mean per bucket instead; ``pixels`` keeps the rows that show in
    a line of so many pixel columns, see ``line_pixels``.
    """
    require_columns(df, [time, value])
    if pixels is not None:
        if bucket is not None:
            raise ValueError("a line has either buckets or pixels")
        return line_pixels(df, time, value, pixels)
    rows = drop_missing(df.select(col(time), col(value)), [time, value])
    if bucket is not None:
        start = F.date_trunc(bucket, col(time))
        if is_datetime(df.schema[time].dataType):
            start = start.cast(df.schema[time].dataType)
        return (
            rows.groupBy(start.alias(time))
            .agg(mean(df, value).alias(value))
            .orderBy(col(time))
        )
    return (
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .orderBy(col(time), col(value), "_tie")
        .drop("_tie")
    )


def line_pixels(df: DataFrame, time: str, value: str, pixels: int) -> DataFrame:
    """The first, last, lowest and highest row of each pixel column, in time order.

    A line drawn through them covers the same pixels as one through all rows.
    The range of times is cut into ``pixels`` columns of equal width, the last
    closed on the right. Rows are aggregated per column, combined on each task,
    so at most four rows a column are sorted, whatever the number of points.
    Among rows of one time the lowest value is first and the highest last; of
    equal lowest values the earliest row stays, of equal highest the latest.
    Times are dates or numbers; others raise, and so does an infinite time.
    """
    require_columns(df, [time, value])
    require_numbers(df, [value], "line chart")
    if pixels < 1:
        raise ValueError("a line needs at least one pixel column")
    data_type = df.schema[time].dataType
    if not is_datetime(data_type):
        require_numbers(df, [time], "line chart of pixels")
    rows = drop_missing(df.select(col(time).alias("t"), col(value).alias("v")), ["t", "v"])
    if is_datetime(data_type):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        at = F.timestamp_diff("MICROSECOND", epoch, F.col("t").cast("timestamp_ntz"))
    else:
        number = F.col("t").cast("double")
        refused = F.raise_error(F.lit(f"column {time} holds infinite values")).cast("double")
        at = F.when(F.abs(number) == F.lit(float("inf")), refused).otherwise(number)
    placed = rows.withColumn("at", at)
    ends = placed.agg(F.struct(F.min("at").alias("lo"), F.max("at").alias("hi")).alias("ends")).scalar()
    width = (ends["hi"] - ends["lo"]) / pixels
    column = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("at") - ends["lo"]) / F.nullif(width, F.lit(0.0))), F.lit(pixels - 1))
    )
    by_time, by_value = F.struct("t", "v"), F.struct("v", "t")
    kept = placed.groupBy(column.alias("column")).agg(
        F.min(by_time).alias("first"), F.max(by_time).alias("last"),
        F.min(by_value).alias("low"), F.max(by_value).alias("high"),
    )

    def turned(name: str) -> Column:
        return F.struct(F.col(f"{name}.t").alias("t"), F.col(f"{name}.v").alias("v"))

    points = F.array_distinct(F.array(F.col("first"), F.col("last"), turned("low"), turned("high")))
    shown = kept.select(F.inline(points))
    return shown.orderBy("t", "v").select(F.col("t").alias(time), F.col("v").alias(value))


def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    require_columns(df, [x, y])
    return drop_missing(df.select(col(x), col(y)), [x, y])


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(slope, intercept, r2, n)`` of least squares; null where x is constant."""
    require_columns(df, [x, y])
    require_numbers(df, [x, y], "trend line")
    vx, vy = as_double(df, x), as_double(df, y)
    return drop_missing(df, [x, y]).agg(
        F.regr_slope(vy, vx).alias("slope"),
        F.regr_intercept(vy, vx).alias("intercept"),
        F.regr_r2(vy, vx).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def shares(df: DataFrame, name: str, value: str) -> DataFrame:
    """``(name, total, share)``: sum per name and its part of the whole."""
    require_columns(df, [name, value])
    require_numbers(df, [value], "pie chart")
    named = drop_missing(df, [name])
    whole = named.agg(total(df, value).alias("total")).scalar()
    sums = named.groupBy(col(name)).agg(total(df, value).alias("total"))
    return sums.withColumn("share", F.col("total") / F.nullif(whole, F.lit(0.0))).orderBy(col(name))


def chart_data(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """The table a chart spec asks for; unknown chart types raise."""
    kind, columns = spec.plot_type.lower(), list(spec.columns)
    require_columns(df, columns)
    if not columns:
        raise ValueError("a chart needs at least one column")
    if kind == "histogram":
        if columns[0] in number_columns(df, with_flags=True):
            return histogram(df, columns[0])
        return top_values(df, columns[0])
    if kind == "bar" and len(columns) == 1:
        return value_counts(df, columns[0])
    builders = {
        "line": time_series,
        "bar": category_means,
        "scatter": scatter_pairs,
        "pie": shares,
    }
    if kind not in builders:
        raise ValueError(f"Unsupported plot type: {kind}")
    if len(columns) < 2:
        raise ValueError(f"a {kind} chart needs two columns")
    return builders[kind](df, columns[0], columns[1])


def charts(df: DataFrame, specs: Sequence[ChartSpec]) -> dict[str, DataFrame]:
    """Chart tables by title; all of them stay lazy."""
    return {s.title: chart_data(df, s) for s in specs}
