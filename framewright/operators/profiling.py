"""Column profiles as one long table, one row per column."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.columns import (
    about_distinct,
    as_double,
    col,
    is_missing,
    local_rows,
    number_columns,
    per_column,
)
from framewright.functions.fixed_values import DISCRETE_BELOW
from framewright.functions.text import two_decimals
from framewright.operators.medians import column_medians

# Estimates up to this, or this near to half the rows, are counted exactly.
FEW_VALUES = 64
NEAR_HALF = 0.2
COUNTS = ["row_count", "missing_count", "distinct_count"]

# Longest cell that travels as it is in a distinct count; longer ones travel
# as a tagged SHA-256, which is longer than any cell sent as it is.
PLAIN_CELL_BYTES = 64

_NUMBER_TYPES = ["tinyint", "smallint", "int", "bigint", "float", "double", "boolean"]
_DATE_TYPES = ["date", "timestamp", "timestamp_ntz"]


def row_and_column_count(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
    ).withColumn("column_count", F.lit(len(df.columns)).cast("bigint"))


def column_information(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, row_count, column_count, missing_count)``."""
    return per_column(
        df,
        df.columns,
        lambda n: {
            "dtype": F.lit(df.schema[n].dataType.simpleString()),
            "row_count": F.count(F.lit(1)),
            "column_count": F.lit(len(df.columns)),
            "missing_count": F.count_if(is_missing(df, n)),
        },
    )


def numeric_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """``(position, column, mean, median, min, max)`` of the numeric columns.

    Flags are left out. ``approx`` takes the median from a sketch in the same
    pass; otherwise it is exact.
    """
    names = number_columns(df)
    if not names:
        return df.sparkSession.range(0).select(
            F.lit(0).alias("position"),
            F.lit("").alias("column"),
            *[F.lit(0.0).alias(m) for m in ("mean", "median", "min", "max")],
        )

    def metrics(name: str) -> dict[str, Column]:
        value = as_double(df, name)
        found = {"mean": F.avg(value), "min": F.min(value), "max": F.max(value)}
        if approx:
            found["median"] = F.percentile_approx(value, 0.5)
        return found

    summary = per_column(df, names, metrics)
    if not approx:
        medians = column_medians(df, names)
        summary = summary.join(
            F.broadcast(medians.select(F.col("column").alias("_column"), "median")),
            F.col("column") == F.col("_column"),
            "left",
        )
    return summary.select("position", "column", "mean", "median", "min", "max")


def profile(df: DataFrame, approx: bool = False, summary: DataFrame | None = None) -> DataFrame:
    """Information of every column beside the summary of the numeric ones.

    ``summary`` is the result of ``numeric_summary`` where it is at hand.
    """
    summary = numeric_summary(df, approx) if summary is None else summary
    # Both sides hold one row per column.
    numbers = summary.drop("position").withColumnRenamed("column", "_column")
    return (
        column_information(df)
        .join(F.broadcast(numbers), F.col("column") == F.col("_column"), "left")
        .drop("_column")
    )


def formatted_statistics(
    df: DataFrame, approx: bool = False, summary: DataFrame | None = None
) -> DataFrame:
    """``(column, mean, median, range)`` as display text."""
    summary = numeric_summary(df, approx) if summary is None else summary
    return summary.select(
        "column",
        two_decimals(F.col("mean")).alias("mean"),
        two_decimals(F.col("median")).alias("median"),
        F.concat(two_decimals(F.col("min")), F.lit(" to "), two_decimals(F.col("max"))).alias(
            "range"
        ),
    )


def _cell_class(data_type: T.DataType) -> str:
    """Type in which cells are compared: whole numbers, doubles or text."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "bigint"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def _comparable(df: DataFrame, name: str) -> Column:
    """A cell in its comparison type; equal exactly when the cells are equal."""
    data_type, value = df.schema[name].dataType, col(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value.cast("double"))
    if isinstance(data_type, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(data_type, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(data_type, T.BooleanType):
        return value.cast("int").cast("bigint")
    if _cell_class(data_type) == "bigint":
        return value.cast("bigint")
    nested = isinstance(data_type, (T.ArrayType, T.StructType, T.MapType))
    text = F.to_json(value) if nested else value.cast("string")
    return F.when(F.octet_length(text) <= PLAIN_CELL_BYTES, text).when(
        text.isNotNull(), F.concat(F.lit("h:"), F.sha2(text, 256))
    )


def _cell_counts(tables: Mapping[str, DataFrame], wanted: set[tuple[str, str]] | None = None) -> DataFrame:
    """``(table_name, position, row_count, missing_count, distinct_count)``.

    Cells go through one long table per comparison type, are merged on each
    task and then shuffled by table, column and value: no column and no hot
    value sits in one task, and a whole catalogue costs three shuffles.
    ``wanted`` limits the work to some ``(table, column)`` pairs.
    """
    by_class: dict[str, list[DataFrame]] = {}
    for table_name, df in tables.items():
        for kind in ("bigint", "double", "string"):
            picked = {
                str(i): f.name
                for i, f in enumerate(df.schema.fields)
                if _cell_class(f.dataType) == kind
                and (wanted is None or (table_name, f.name) in wanted)
            }
            if not picked:
                continue
            long = df.select(*[_comparable(df, n).alias(i) for i, n in picked.items()]).unpivot(
                [], list(picked), "position", "cell"
            )
            by_class.setdefault(kind, []).append(
                long.select(F.lit(table_name).alias("table_name"), "position", "cell")
            )
    counted = []
    for parts in by_class.values():
        merged = (
            reduce(DataFrame.unionAll, parts)
            .groupBy("table_name", "position", "cell")
            .agg(F.count(F.lit(1)).alias("copies"))
        )
        missing = F.when(F.col("cell").isNull(), F.col("copies"))
        counted.append(
            merged.groupBy("table_name", F.col("position").cast("int").alias("position")).agg(
                F.sum("copies").alias("row_count"),
                F.coalesce(F.sum(missing), F.lit(0)).alias("missing_count"),
                F.count("cell").alias("distinct_count"),
            )
        )
    return reduce(DataFrame.unionAll, counted)


def _sketch_counts(tables: Mapping[str, DataFrame], text_only: bool = False) -> DataFrame:
    """The same from one pass of sketches; ``distinct_count`` is an estimate.

    With ``text_only`` other columns are not hashed, and their count is null.
    """

    def about(df: DataFrame, n: str) -> Column:
        if text_only and not isinstance(df.schema[n].dataType, T.StringType):
            return F.lit(None).cast("bigint")
        return about_distinct(col(n))

    parts = [
        per_column(
            df,
            df.columns,
            lambda n, df=df: {
                "row_count": F.count(F.lit(1)),
                "missing_count": F.count_if(is_missing(df, n)),
                "distinct_count": about(df, n),
            },
        ).select(F.lit(table_name).alias("table_name"), "position", *COUNTS)
        for table_name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def _near_a_limit(distinct: int, rows: int) -> bool:
    """Whether an estimate leaves a role or a chart rule open."""
    return distinct <= FEW_VALUES or abs(2 * distinct - rows) <= NEAR_HALF * rows


def _decisive_counts(tables: Mapping[str, DataFrame], text_only: bool = False) -> DataFrame:
    """Sketches, replaced by exact counts where a rule could go either way."""
    names = {t: df.columns for t, df in tables.items()}
    rows = [tuple(r) for r in _sketch_counts(tables, text_only).collect()]  # one row per column
    wanted = {
        (t, names[t][position])
        for t, position, row_count, _, distinct in rows
        if distinct is not None and _near_a_limit(distinct, row_count)
    }
    spark = next(iter(tables.values())).sparkSession
    settled = local_rows(
        spark,
        [r for r in rows if (r[0], names[r[0]][r[1]]) not in wanted],
        table_name="string",
        position="int",
        row_count="bigint",
        missing_count="bigint",
        distinct_count="bigint",
    )
    return settled.unionAll(_cell_counts(tables, wanted)) if wanted else settled


def distinct_counts(df: DataFrame, counting: str = "exact") -> DataFrame:
    """``(position, column, distinct_count)`` of the non-null values."""
    return column_roles(df, counting=counting).select("position", "column", "distinct_count")


def column_roles(df: DataFrame, table_name: str = "", counting: str = "exact") -> DataFrame:
    """The profile the chart rules work on, one row per column.

    ``(table_name, position, column, dtype, row_count, missing_count,
    distinct_count, role, subtype)``.
    """
    return catalogue_roles({table_name: df}, counting)


def catalogue_roles(tables: Mapping[str, DataFrame], counting: str = "exact") -> DataFrame:
    """Column roles of many tables, as one table.

    ``counting`` is ``exact``, ``approx`` (sketches only), ``decisive`` (exact
    roles; distinct counts far from every limit are estimates) or ``rules``
    (the same for text columns, all that chart rules look at; other columns
    have neither a distinct count nor a subtype).
    """
    keys = ["table_name", "position"]
    counts = {
        "exact": _cell_counts,
        "approx": _sketch_counts,
        "decisive": _decisive_counts,
        "rules": lambda t: _decisive_counts(t, text_only=True),
    }[counting](tables)
    spark = next(iter(tables.values())).sparkSession
    known = local_rows(
        spark,
        [
            (t, i, f.name, f.dataType.simpleString())
            for t, df in tables.items()
            for i, f in enumerate(df.schema.fields)
        ],
        table_name="string",
        position="int",
        column="string",
        dtype="string",
    )
    # Both sides hold one row per column.
    rows = known.join(F.broadcast(counts), keys, "left").select(
        *keys,
        "column",
        "dtype",
        *[
            (F.col(c) if counting == "rules" and c == "distinct_count" else F.coalesce(c, F.lit(0))).alias(c)
            for c in COUNTS
        ],
    )
    dtype = F.col("dtype")
    number = dtype.isin(_NUMBER_TYPES) | dtype.startswith("decimal")
    few = 2 * F.col("distinct_count") < F.col("row_count")
    role = (
        F.when(number, "numeric")
        .when(dtype.isin(_DATE_TYPES), "datetime")
        .when((dtype == "string") & few, "categorical")
        .otherwise("other")
    )
    discrete = F.when(F.col("distinct_count") < DISCRETE_BELOW, "discrete").otherwise("continuous")
    counted = number & F.col("distinct_count").isNotNull()
    return rows.select("*", role.alias("role"), F.when(counted, discrete).alias("subtype"))
