"""Structured queries: filter, group, aggregate; order look-up; plain SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.columns import (
    as_double,
    col,
    is_number,
    mean,
    number_columns,
    require_columns,
    require_numbers,
)
from framewright.functions.fixed_values import (
    NULL_TEXT,
    ORDER_QUESTION,
    ORDER_RELATIONS,
    ORDER_WORDS,
)
from framewright.functions.text import first_digits
from framewright.operators.aggregates import MEDIAN, aggregate_column, check_aggregate
from framewright.operators.cleaning import drop_missing
from framewright.operators.lookups import lookup_join
from framewright.session import reliable
from framewright.operators.medians import grouped_median

INTENTS = ("filter", "aggregate", "trend", "comparison", "correlation")


class ChartSpec(NamedTuple):
    title: str
    plot_type: str
    columns: list[str]
    explanation: str


# Chart drawn for an intent: title, plot type, explanation (fixed values).
INTENT_CHARTS = {
    "trend": ("Trend Analysis", "line", "Shows the trend over time"),
    "comparison": ("Comparison Analysis", "bar", "Compares values across categories"),
    "correlation": ("Correlation Analysis", "scatter", "Shows relationship between variables"),
}


@dataclass(frozen=True)
class Intent:
    """What a question asks for. The default selects nothing."""

    intent: str = "filter"
    columns: Sequence[str] = ()
    filters: Mapping[str, Any] = field(default_factory=dict)
    aggregation: str | None = "count"
    groupby: Sequence[str] = ()

    @classmethod
    def from_record(cls, record: Mapping[str, Any]) -> Intent:
        """From ``{"intent": ..., "parameters": {...}}``; absent parts are empty."""
        p = record.get("parameters") or {}
        return cls(
            intent=record.get("intent") or "filter",
            columns=list(p.get("columns") or []),
            filters=dict(p.get("filters") or {}),
            aggregation=p.get("aggregation") or None,
            groupby=list(p.get("groupby") or []),
        )


class Answer(NamedTuple):
    data: DataFrame
    explanation: str
    chart: ChartSpec | None


def equals_number(df: DataFrame, name: str, number: float) -> Column:
    """Numeric equality; a column that holds no numbers matches nothing."""
    data_type = df.schema[name].dataType
    if isinstance(number, int):  # a flag is 1 or 0
        number = int(number) if abs(number) < 2**63 else float(number)
    if isinstance(data_type, T.BooleanType):
        return col(name).cast("int") == F.lit(number)
    if isinstance(data_type, T.FloatType):  # 0.1 as a float, not as a double
        return col(name) == F.lit(number).cast("float")
    return col(name) == F.lit(number) if is_number(data_type) else F.lit(False)


def contains_text(
    df: DataFrame, name: str, text: str, literal: bool = False, match_null_text: bool = False
) -> Column:
    """Case-insensitive search in the column's text form.

    The text is a regular expression (Java dialect) unless ``literal``.
    ``match_null_text`` lets missing cells match as ``nan``.
    """
    shown = col(name).cast("string")
    if match_null_text:
        shown = F.coalesce(shown, F.lit(NULL_TEXT))
    if literal:
        return F.lower(shown).contains(text.lower())
    return shown.rlike("(?iu)" + text)


def apply_filters(
    df: DataFrame, filters: Mapping[str, Any], literal: bool = False, match_null_text: bool = False
) -> DataFrame:
    """All conditions hold; conditions on unknown columns are ignored."""
    for name, value in filters.items():
        if name not in df.columns:
            continue
        if isinstance(value, (int, float)):
            df = df.filter(equals_number(df, name, value))
        else:
            df = df.filter(contains_text(df, name, str(value), literal, match_null_text))
    return df


def group_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    function: str,
    order_by: str | None = None,
) -> DataFrame:
    """One function over every value column per key; null keys are dropped.

    Output keeps the input names and is sorted by key. Every function combines
    on each task first, so a hot key sends one row per task to the shuffle;
    distinct counts shuffle on key and value together.
    """
    keys = list(dict.fromkeys(keys))
    columns = [c for c in dict.fromkeys(columns) if c not in keys]
    require_columns(df, [*keys, *columns, *([order_by] if order_by else [])])
    check_aggregate(df, function, columns)
    keyed = drop_missing(df, keys)
    if function == MEDIAN:
        result = grouped_median(keyed, keys, columns)
    else:
        result = keyed.groupBy(*[col(k) for k in keys]).agg(
            *[aggregate_column(df, function, c, order_by) for c in columns]
        )
    return result.orderBy(*[col(k) for k in keys])


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*[col(c) for c in columns])


def explain_intent(intent: Intent) -> str:
    parts = []
    if intent.filters:
        conditions = ", ".join(f"{k}={v}" for k, v in intent.filters.items())
        parts.append(f"Filtered data where {conditions}. ")
    if intent.groupby:
        parts.append(f"Grouped by {', '.join(intent.groupby)}. ")
    if intent.aggregation:
        parts.append(f"Calculated {intent.aggregation} of {', '.join(intent.columns)}.")
    return "".join(parts)


def intent_chart(intent: Intent) -> ChartSpec | None:
    if intent.intent not in INTENT_CHARTS:
        return None
    title, plot_type, explanation = INTENT_CHARTS[intent.intent]
    return ChartSpec(title, plot_type, list(intent.columns)[:2], explanation)


def run_intent(
    df: DataFrame,
    intent: Intent,
    order_by: str | None = None,
    literal: bool = False,
    match_null_text: bool = False,
) -> Answer:
    """Filters, then grouping if keys, function and value columns are all given."""
    if intent.intent not in INTENTS:
        raise ValueError(f"unknown intent {intent.intent!r}; known are {', '.join(INTENTS)}")
    data = apply_filters(df, intent.filters, literal, match_null_text)
    values = [c for c in intent.columns if c not in intent.groupby]
    if intent.groupby and intent.aggregation and values:
        data = group_aggregate(data, intent.groupby, values, intent.aggregation, order_by)
    return Answer(data, explain_intent(intent), intent_chart(intent))


def order_column(df: DataFrame) -> str | None:
    """The first column whose name speaks of orders."""
    return next((c for c in df.columns if any(w in c.lower() for w in ORDER_WORDS)), None)


def order_question_id(question: str) -> str | None:
    """Order id asked for, as text; None when the question asks something else."""
    asked = question.lower().strip()
    if ORDER_QUESTION not in asked or not any(w in asked for w in ORDER_RELATIONS):
        return None
    digits = "".join(c if c.isascii() and c.isdigit() else " " for c in asked).split()
    return digits[0] if digits else None


def order_lookup(df: DataFrame, question: str) -> Answer | None:
    """The lines of the order a question names; None if it names none."""
    order_id, key = order_question_id(question), order_column(df)
    if order_id is None or key is None:
        return None
    lines = df.filter(_same_id(df, key, order_id))
    count = lines.count()
    chart = ChartSpec(
        f"Order Details for Sales Order {order_id}",
        "bar",
        [c for c in df.columns if c != key][:2],
        "Shows the breakdown of the sales order",
    )
    return Answer(lines, f"Found {count} order lines for sales order {order_id}", chart)


def write_order_layout(
    df: DataFrame, path: str, key: str | None = None, row_group_bytes: int = 16 << 20
) -> None:
    """Parquet files in ranges of the order id, in which a look-up of one id skips nearly all row groups.

    Row groups hold narrow ranges of ids, and a Bloom filter of the ids they
    hold, so numbers and texts are both skipped. Rows of one id are spread by
    a hash of the row: an order with very many lines fills several files.
    """
    key = key or order_column(df)
    if key is None:
        raise ValueError("no column speaks of orders")
    spread = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.AtomicType,))]
    placed = df.withColumn("_spread", F.xxhash64(*[col(n) for n in spread]))
    ordered = placed.repartitionByRange(col(key), F.col("_spread")).sortWithinPartitions(col(key))
    options = {
        f"parquet.bloom.filter.enabled#{key}": "true",
        "parquet.bloom.filter.adaptive.enabled": "true",
        "parquet.block.size": str(row_group_bytes),
    }
    ordered.drop("_spread").write.options(**options).parquet(path)


def _same_id(df: DataFrame, key: str, order_id: str) -> Column:
    """Equality on the id's text form; on numbers a comparison the scan can use."""
    data_type = df.schema[key].dataType
    if is_number(data_type):
        plain = str(int(order_id)) == order_id and int(order_id) < 2**63
        return col(key) == F.lit(int(order_id)).cast(data_type) if plain else F.lit(False)
    return col(key).cast("string") == F.lit(order_id)


def _id_text(df: DataFrame, key: str) -> Column:
    """Text form of an id; whole doubles and decimals (integers with gaps) as integers."""
    data_type = df.schema[key].dataType
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = col(key).try_cast("decimal(38,0)")
        return F.when(whole.cast(data_type) == col(key), whole.cast("string")).otherwise(
            col(key).cast("string")
        )
    return col(key).cast("string")


def order_line_counts(df: DataFrame, questions: DataFrame, question: str) -> DataFrame:
    """``questions`` with ``order_id`` and ``line_count`` for a whole table of questions.

    Lines are counted per order before the join, so an order with very many
    lines is one row in it. Questions that name no order keep null.
    """
    key = order_column(df)
    if key is None:
        raise ValueError("no column speaks of orders")
    asked = F.lower(F.trim(col(question)))
    related = F.lit(False)
    for word in ORDER_RELATIONS:
        related = related | asked.contains(word)
    order_id = F.when(asked.contains(ORDER_QUESTION) & related, first_digits(asked))
    counts = df.groupBy(_id_text(df, key).alias("_id")).agg(F.count(F.lit(1)).alias("_lines"))
    asking = questions.withColumn("order_id", order_id)
    # Ask for each order once, then hand the count back to every question.
    found = asking.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_asked")
    )
    lookup = found.join(counts, F.col("order_id") == F.col("_id"), "left").select(
        F.col("order_id").alias("key"),
        F.coalesce("_lines", F.lit(0)).alias("value"),
        F.col("_asked").alias("occurrences"),
    )
    # Written once: the look-up is read for its total, its heavy and its light keys.
    return lookup_join(asking, "order_id", reliable(lookup), "line_count")


def relationship(df: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Mean of y per x, and the Pearson correlation of both.

    Returns ``(x, mean_y, n)`` sorted by x and the one row
    ``(n, pearson)``; a constant column has no correlation (null).
    """
    require_columns(df, [x, y])
    require_numbers(df, [y], "relationship")
    rows = drop_missing(df, [x, y])
    groups = (
        rows.groupBy(col(x))
        .agg(mean(df, y).alias("mean_y"), F.count(F.lit(1)).alias("n"))
        .orderBy(col(x))
    )
    if x in number_columns(df, with_flags=True):
        strength = correlation(as_double(df, x), as_double(df, y))
    else:
        strength = F.lit(None).cast("double")
    return groups, rows.agg(F.count(F.lit(1)).alias("n"), strength.alias("pearson"))


def correlation(x: Column, y: Column) -> Column:
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.covar_samp(x, y) / F.nullif(spread, F.lit(0.0))


def custom_query(df: DataFrame, sql: str, view: str = "data") -> DataFrame:
    """Any Spark SQL over the frame, which the text names ``data``."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(sql)
