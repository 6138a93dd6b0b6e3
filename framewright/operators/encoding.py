"""Categorical encoding: choice per column, labels, one-hot, substitution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.columns import (
    about_distinct,
    cells,
    col,
    local_rows,
    per_column,
    require_columns,
    text_columns,
    unique_names,
)
from framewright.functions.fixed_values import (
    LABEL_MAX_BINARY,
    NULL_TEXT,
    ONE_HOT_MAX,
    SAMPLE_ROWS,
)
from framewright.operators.lookups import lookup_join
from framewright.operators.sampling import sample_rows
from framewright.session import reliable

# How far above half the rows an estimated distinct count must lie to rule a
# column out without counting: over ten times the sketch's error.
NEAR_HALF = 0.2
# Largest dictionary that is broadcast: rows and bytes are both checked.
DICTIONARY_ROWS = 10_000
DICTIONARY_BYTES = 16 * 1024 * 1024
# Bytes of all broadcast dictionaries of one frame together.
ALL_DICTIONARY_BYTES = 64 * 1024 * 1024
# Labels written as a chain of comparisons instead of a join.
INLINE_LABELS = 16


@dataclass(frozen=True)
class EncodingChoice:
    column: str
    kind: str  # none, label, one_hot
    values: tuple[str, ...] | None = None  # sorted classes where they are few


class EncodingPlan(NamedTuple):
    choices: list[EncodingChoice]
    classes: DataFrame | None  # (column, key, occurrences, present)


class Encoded(NamedTuple):
    data: DataFrame
    mapping: dict[str, list[str]]


def encoding_kind(distinct: int, missing: int, rows: int) -> str:
    """``distinct`` non-null values and ``missing`` nulls in ``rows`` rows."""
    if 2 * distinct > rows or 2 * missing > rows:
        return "none"
    if distinct <= LABEL_MAX_BINARY or distinct > ONE_HOT_MAX:
        return "label"
    return "one_hot"


def _class_of(c: Column) -> Column:
    """Text form of a cell; a missing cell is a class of its own."""
    return F.coalesce(c.cast("string"), F.lit(NULL_TEXT))


def class_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, key, occurrences, present)`` of several columns, written once.

    Counts combine on each task, so a class sends one row per task.
    """
    counted = (
        cells(df, names)
        .groupBy("column", _class_of(F.col("cell")).alias("key"))
        .agg(F.count(F.lit(1)).alias("occurrences"), F.count("cell").alias("present"))
    )
    return reliable(counted)


def _class_sizes(classes: DataFrame) -> dict[str, dict]:
    """Per column: distinct non-null values, classes, and bytes of the classes."""
    sizes = classes.groupBy("column").agg(
        F.count_if(F.col("present") > 0).alias("distinct"),
        F.count(F.lit(1)).alias("classes"),
        F.sum(F.octet_length("key")).alias("bytes"),
    )
    return {r["column"]: r.asDict() for r in sizes.collect()}  # one row per column


def _small_dictionaries(
    classes: DataFrame, sizes: Mapping[str, dict], names: Sequence[str], max_rows: int
) -> dict[str, list[tuple[str, int]]]:
    """Sorted ``(key, present)`` of the columns whose size allows a broadcast."""
    small, used = [], 0
    for n in sorted(names, key=lambda n: sizes[n]["bytes"]):
        used += sizes[n]["bytes"]
        if (
            sizes[n]["classes"] <= max_rows
            and sizes[n]["bytes"] <= DICTIONARY_BYTES
            and used <= ALL_DICTIONARY_BYTES
        ):
            small.append(n)
    if not small:
        return {}
    found: dict[str, list[tuple[str, int]]] = {n: [] for n in small}
    for r in classes.filter(F.col("column").isin(small)).collect():
        found[r["column"]].append((r["key"], r["present"]))
    return {n: sorted(pairs) for n, pairs in found.items()}


def encoding_plan(df: DataFrame, names: Sequence[str] | None = None) -> EncodingPlan:
    """Choice per text column.

    One pass of sketches rules out the columns that are nearly unique or
    mostly missing. The classes of the others are counted exactly, in one
    table that later steps read too; no choice rests on an estimate near a
    limit.
    """
    names = list(text_columns(df) if names is None else names)
    if not names:
        return EncodingPlan([], None)
    stats = per_column(
        df,
        names,
        lambda n: {
            "rows": F.count(F.lit(1)),
            "missing": F.count_if(col(n).isNull()),
            "about": about_distinct(col(n)),
        },
    ).collect()
    open_columns = [
        s["column"]
        for s in stats
        if 2 * s["missing"] <= s["rows"] and 2 * s["about"] <= (1 + NEAR_HALF) * s["rows"]
    ]
    if not open_columns:
        return EncodingPlan([EncodingChoice(n, "none") for n in names], None)
    classes = class_table(df, open_columns)
    sizes = _class_sizes(classes)
    kinds = {
        s["column"]: encoding_kind(sizes[s["column"]]["distinct"], s["missing"], s["rows"])
        for s in stats
        if s["column"] in sizes
    }
    chosen = [n for n, kind in kinds.items() if kind != "none"]
    dictionaries = _small_dictionaries(classes, sizes, chosen, DICTIONARY_ROWS)
    choices = []
    for n in names:
        kind = kinds.get(n, "none")
        values = None
        if n in dictionaries:
            # One-hot flags are for present values; labels include the missing class.
            keep_all = kind == "label"
            values = tuple(k for k, present in dictionaries[n] if keep_all or present)
        elif kind == "one_hot":
            raise ValueError(f"the values of column {n} are too long to become column names")
        choices.append(EncodingChoice(n, kind, values))
    return EncodingPlan(choices, classes)


def _inline_label(name: str, values: Sequence[str]) -> Column:
    label = F.lit(None).cast("bigint")
    for code, value in reversed(list(enumerate(values))):
        same = _class_of(col(name)) == F.lit(value)
        label = F.when(same, F.lit(code).cast("bigint")).otherwise(label)
    return label


def _with_label(
    df: DataFrame, name: str, output: str, values: Sequence[str] | None, classes: DataFrame
) -> DataFrame:
    if values is not None and len(values) <= INLINE_LABELS:
        return df.withColumn(output, _inline_label(name, values))
    if values is not None:
        codes = local_rows(
            df.sparkSession, list(zip(values, range(len(values)))), _class="string", _code="bigint"
        )
        joined = df.join(F.broadcast(codes), _class_of(col(name)) == F.col("_class"), "left")
        return joined.select(*[col(n) for n in df.columns], F.col("_code").alias(output))
    ranked = rank_classes(classes.filter(F.col("column") == name))
    probed = df.withColumn("_class", _class_of(col(name)))
    return lookup_join(probed, "_class", ranked, output).drop("_class")


def label_encode(
    df: DataFrame, name: str, output: str | None = None, dictionary_rows: int = DICTIONARY_ROWS
) -> DataFrame:
    """Rank (from 0) of the cell among the sorted distinct text forms.

    A dictionary of checked size is broadcast; a larger one is ranked and
    joined in parallel.
    """
    require_columns(df, [name])
    classes = class_table(df.select(col(name).cast("string").alias(name)), [name])
    sizes = _class_sizes(classes)
    small = _small_dictionaries(classes, sizes, list(sizes), dictionary_rows)
    values = [k for k, _ in small[name]] if name in small else ([] if not sizes else None)
    return _with_label(df, name, output or f"{name}_encoded", values, classes)


def rank_classes(classes: DataFrame) -> DataFrame:
    """``(key, value, occurrences)``: each class with its place in the sorted order.

    Classes are range-partitioned, sorted within partitions and written once,
    so that every reader sees the same partitions. A class's rank is the
    number of classes in earlier partitions plus its place in its own.
    """
    placed = reliable(
        classes.select("key", "occurrences")
        .repartitionByRange("key")
        .sortWithinPartitions("key")
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_place", F.col("_id") - F.shiftleft("_part", 33))
    )
    # One row per partition: small by construction.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_part").alias("_start_part"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
    )
    return placed.join(F.broadcast(starts), F.col("_part") == F.col("_start_part")).select(
        "key", (F.col("_start") + F.col("_place")).alias("value"), "occurrences"
    )


def one_hot(df: DataFrame, name: str, values: Sequence[str] | None = None) -> DataFrame:
    """A flag per sorted value but the first; a missing cell has no flag set.

    ``values`` are the sorted distinct values where they are known.
    """
    require_columns(df, [name])
    if values is None:
        found = (
            df.select(col(name).alias("v")).filter("v IS NOT NULL").distinct().limit(ONE_HOT_MAX + 1)
        ).collect()
        if len(found) > ONE_HOT_MAX:
            raise ValueError(f"column {name} has more than {ONE_HOT_MAX} values")
        values = sorted(r["v"] for r in found)
    names = one_hot_names(df, name, values)
    return df.withColumns(
        {
            fresh: F.coalesce(col(name) == F.lit(v), F.lit(False))
            for fresh, v in zip(names, values[1:])
        }
    )


def one_hot_names(df: DataFrame, name: str, values: Sequence[str]) -> list[str]:
    """Names of the flags; a name the frame already has is numbered."""
    wanted = [f"{name}_{v}" for v in values[1:]]
    return unique_names([*df.columns, *wanted])[len(df.columns) :]


def encode(df: DataFrame, plan: EncodingPlan | None = None) -> Encoded:
    """Every eligible text column encoded, new columns to the right.

    The mapping lists, per original column, the columns made from it.
    """
    plan = encoding_plan(df) if plan is None else plan
    mapping: dict[str, list[str]] = {}
    for choice in plan.choices:
        if choice.kind == "one_hot":
            before = len(df.columns)
            df = one_hot(df, choice.column, choice.values)
            mapping[choice.column] = df.columns[before:]
        elif choice.kind == "label":
            output = unique_names([*df.columns, f"{choice.column}_encoded"])[-1]
            df = _with_label(df, choice.column, output, choice.values, plan.classes)
            mapping[choice.column] = [output]
    return Encoded(df, mapping)


def mapping_table(spark: SparkSession, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(k, list(v)) for k, v in mapping.items()]
    return local_rows(spark, rows, original="string", columns="array<string>")


def encoded_sample(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] | None = None,
    max_rows: int = SAMPLE_ROWS,
    plan: EncodingPlan | None = None,
) -> DataFrame:
    """The same from a frame that isn't encoded yet: rows are sampled first.

    The plan is that of the whole frame, so the values are those of the whole
    frame's encoding; only the sampled rows are joined to dictionaries.
    """
    plan = encoding_plan(df) if plan is None else plan
    shown = EncodingPlan([c for c in plan.choices if c.column in columns], plan.classes)
    encoded = encode(reliable(sample_rows(df, keys, max_rows)), shown)
    return encoded.data.select(
        *[
            (col(encoded.mapping[n][0]) if encoded.mapping.get(n) else col(n)).alias(n)
            for n in df.columns
        ]
    )


def substitute_encoded(
    df: DataFrame,
    mapping: Mapping[str, Sequence[str]],
    columns: Sequence[str],
    keys: Sequence[str] | None = None,
    max_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """A chart sample in which encoded columns show their first encoding."""
    sampled = sample_rows(df, keys, max_rows)
    return sampled.select(
        *[
            (col(mapping[n][0]) if n in columns and mapping.get(n) else col(n)).alias(n)
            for n in df.columns
        ]
    )
