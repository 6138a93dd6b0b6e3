"""Profiles kept per file and merged, so that an append reads only new files.

A file's profile is one row per column: counts, the total, the range, and two
sketches, one of the distinct values and one of the distribution. All of them
merge: a table's profile is an aggregate over the rows of its files, whatever
the order they were profiled in. Counts and ranges are exact, and so are totals
of whole numbers and decimals; distinct counts and medians are estimates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.columns import COLUMNS_PER_PASS, as_double, col, is_missing, is_number
from framewright.session import stored_or_empty

# Registers of the distinct sketch, 2 to this power: about 1.6 % off.
DISTINCT_BITS = 12
# Size of the distribution sketch: ranks about 0.7 % off.
RANK_SIZE = 400

FILE_KEYS = ["file", "file_size", "modified"]
PROFILE_SCHEMA = (
    "file string, file_size bigint, modified timestamp, position int, column string, dtype string, "
    "row_count bigint, missing_count bigint, whole_total decimal(38,6), total double, low double, high double, "
    "distinct_sketch binary, rank_sketch binary"
)


def _facts(df: DataFrame, position: int, name: str) -> Column:
    data_type = df.schema[name].dataType
    number = is_number(data_type)
    exact = number and not isinstance(data_type, (T.DoubleType, T.FloatType))
    value = as_double(df, name) if number else F.lit(None).cast("double")
    present = F.when(~is_missing(df, name), col(name))
    nothing = F.lit(None).cast("binary")
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(name).alias("column"),
        F.lit(data_type.simpleString()).alias("dtype"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(is_missing(df, name)).alias("missing_count"),
        (F.sum(col(name).cast("decimal(38,6)")) if exact else F.lit(None)).cast("decimal(38,6)").alias("whole_total"),
        (F.sum(value) if number and not exact else F.lit(None).cast("double")).alias("total"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.hll_sketch_agg(F.when(present.isNotNull(), F.xxhash64(present)), F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
        (F.kll_sketch_agg_double(value, F.lit(RANK_SIZE)) if number else nothing).alias("rank_sketch"),
    )


def file_profiles(df: DataFrame) -> DataFrame:
    """One row per file and column of a frame that was read from files.

    Aggregates are combined on each task, so a file that many tasks read costs
    one short row for each of them.
    """
    held = df.select(
        *[col(n) for n in df.columns],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_modification_time").alias("_modified"),
    )
    parts = None
    for a in range(0, len(df.columns), COLUMNS_PER_PASS):
        facts = [_facts(df, a + i, n).alias(f"c{i}") for i, n in enumerate(df.columns[a : a + COLUMNS_PER_PASS])]
        wide = held.groupBy("_file", "_size", "_modified").agg(*facts)
        some = wide.select(
            F.col("_file").alias("file"),
            F.col("_size").alias("file_size"),
            F.col("_modified").alias("modified"),
            F.inline(F.array(*[F.col(f"c{i}") for i in range(len(facts))])),
        )
        parts = some if parts is None else parts.unionByName(some)
    return parts


def files_of(spark: SparkSession, path) -> DataFrame:
    """Path, size and time of the files; only their list is read."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
    )


def update_profiles(spark: SparkSession, path, store: str, format: str = "parquet", **options) -> list[str]:
    """Profile the files that the store doesn't know, or knows with another size or time; returns them.

    The driver holds the names of the new files, as it does to plan their scan.
    """
    known = stored_or_empty(spark, store, PROFILE_SCHEMA).select(*FILE_KEYS).distinct()
    new = [r["file"] for r in files_of(spark, path).join(known, FILE_KEYS, "left_anti").select("file").collect()]
    if new:
        frame = spark.read.format(format).options(**options).load(path)
        # The names choose files before any is opened.
        chosen = frame.filter(F.col("_metadata.file_path").isin(new))
        file_profiles(chosen).write.mode("append").parquet(store)
    return sorted(new)


def table_profile(spark: SparkSession, path, store: str) -> DataFrame:
    """The profile of the files that are there now, from the store alone.

    ``(position, column, dtype, row_count, column_count, missing_count, mean,
    median, min, max, distinct_count)``. Median and distinct count are estimates.
    """
    current = stored_or_empty(spark, store, PROFILE_SCHEMA).join(files_of(spark, path), FILE_KEYS, "left_semi")
    return merged_profile(current.dropDuplicates([*FILE_KEYS, "column"]))


def merged_profile(profiles: DataFrame) -> DataFrame:
    """One row per column over any number of file profiles."""
    merged = profiles.groupBy("column", "dtype").agg(
        F.min("position").alias("position"),
        F.sum("row_count").alias("row_count"),
        F.sum("missing_count").alias("missing_count"),
        F.sum("whole_total").cast("double").alias("whole"),
        F.sum("total").alias("total"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count"),
        F.kll_merge_agg_double("rank_sketch", F.lit(RANK_SIZE)).alias("ranks"),
    )
    present = F.nullif(F.col("row_count") - F.col("missing_count"), F.lit(0))
    number = F.col("max").isNotNull()
    columns = profiles.agg(F.count_distinct("column").cast("int")).scalar()
    return merged.select(
        "position",
        "column",
        "dtype",
        "row_count",
        columns.alias("column_count"),
        "missing_count",
        (F.coalesce("whole", "total") / present).alias("mean"),
        F.when(number, F.kll_sketch_get_quantile_double("ranks", F.lit(0.5))).alias("median"),
        "min",
        "max",
        "distinct_count",
    )
