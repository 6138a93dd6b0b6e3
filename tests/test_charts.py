"""Chart tables and recommendations at their limits."""

import datetime as dt

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewright.operators import charting as ch
from framewright.operators import recommending as rc
from framewright.operators.profiling import catalogue_roles, column_roles, distinct_counts
from framewright.operators.querying import ChartSpec
from framewright.operators.sampling import sample_rows


@pytest.mark.parametrize("seed, bins", [(1, 30), (2, 7), (3, 30)])
def test_histogram_equals_numpy(spark, seed, bins):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(50, 20, 2000), 1).tolist() + [0.3, 0.6, 0.9]
    frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    counts, edges = np.histogram(values, bins=bins)
    got = rows(ch.histogram(frame, "x", bins), "bin")
    assert [r[3] for r in got] == counts.tolist()
    assert [r[1] for r in got] == pytest.approx(edges[:-1].tolist())
    assert got[-1][2] == edges[-1]


def test_histogram_of_one_value(spark):
    frame = spark.createDataFrame([(4.0,)] * 3, "x double")
    got = rows(ch.histogram(frame, "x"), "bin")
    assert (got[0][1], got[-1][2]) == (3.5, 4.5)
    assert [r[3] for r in got] == np.histogram([4.0] * 3, bins=30)[0].tolist()


def test_bars_drop_missing(spark):
    frame = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", None), (None, 5.0), ("c", 3.0)], "k string, v double"
    )
    assert rows(ch.category_means(frame, "k", "v")) == [("a", 1.0), ("c", 3.0)]
    assert rows(ch.category_means_and_counts(frame, "k", "v")) == [("a", 1.0, 1), ("b", None, 0), ("c", 3.0, 1)]
    assert rows(ch.value_counts(frame, "k")) == [("a", 2), ("b", 1), ("c", 1)]


def test_line_keeps_every_row_in_order(spark):
    day = dt.datetime(2024, 1, 1)
    data = [(day, float(i)) for i in range(50)] + [(day - dt.timedelta(days=1), 9.0), (None, 1.0), (day, None)]
    frame = spark.createDataFrame(data, "t timestamp_ntz, v double").repartition(5)
    got = rows(ch.time_series(frame, "t", "v"))
    assert len(got) == 51 and got[0] == (day - dt.timedelta(days=1), 9.0)
    assert got == sorted(got)
    assert rows(ch.time_series(frame, "t", "v", "month")) == [
        (dt.datetime(2023, 12, 1), 9.0), (dt.datetime(2024, 1, 1), 24.5)
    ]


def test_shares_sum_to_one(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 5.0), ("c", None), (None, 7.0)], "k string, v double")
    got = rows(ch.shares(frame, "k", "v"))
    assert got == [("a", 6.0, 0.75), ("b", 2.0, 0.25), ("c", 0.0, 0.0)]


def test_trend_line_of_constant(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert ch.trend_line(frame, "x", "y").first()["slope"] is None


def test_chart_choice(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")

    def columns(kind, *names):
        return ch.chart_data(frame, ChartSpec("t", kind, list(names), "")).columns

    assert columns("Histogram", "v") == ["bin", "low", "high", "count"]
    assert columns("histogram", "k") == ["k", "count"]
    assert columns("bar", "k") == ["k", "count"]
    assert columns("BAR", "k", "v") == ["k", "mean"]
    assert columns("line", "k", "v") == columns("scatter", "k", "v") == ["k", "v"]
    assert columns("pie", "k", "v") == ["k", "total", "share"]
    for bad in (("radar", "k", "v"), ("bar", "gone"), ("line", "k")):
        with pytest.raises(ValueError):
            columns(*bad)


def test_sample_size(spark):
    small, large = spark.range(1000), spark.range(1001)
    assert sample_rows(small, ["id"]).count() == 1000
    once = rows(sample_rows(large, ["id"]), "id")
    assert len(set(once)) == 1000
    assert once == rows(sample_rows(large.repartition(7), ["id"]), "id")


@pytest.mark.parametrize("counting", ["exact", "decisive"])
def test_roles_at_their_limits(spark, counting):
    n = 40
    frame = spark.range(n).select(
        (F.col("id") % 19).alias("n19"),
        (F.col("id") % 20).cast("double").alias("n20"),
        (F.col("id") % 2 == 0).alias("flag"),
        (F.col("id") % 19).cast("string").alias("c19"),
        (F.col("id") % 20).cast("string").alias("c20"),
        F.timestamp_seconds("id").alias("t"),
        F.lit("2024-01-01").cast("date").alias("d"),
        F.array("id").alias("list"),
        F.when(F.col("id") < 10, F.repeat(F.lit("long"), 100)).alias("long"),
    )
    got = {r["column"]: (r["role"], r["subtype"], r["distinct_count"], r["missing_count"])
           for r in column_roles(frame, counting=counting).collect()}
    assert got == {
        "n19": ("numeric", "discrete", 19, 0),
        "n20": ("numeric", "continuous", 20, 0),
        "flag": ("numeric", "discrete", 2, 0),
        "c19": ("categorical", None, 19, 0),
        "c20": ("other", None, 20, 0),
        "t": ("datetime", None, 40, 0),
        "d": ("datetime", None, 1, 0),
        "list": ("other", None, 40, 0),
        "long": ("categorical", None, 1, 30),
    }


def test_distinct_counts_see_equal_cells(spark):
    frame = spark.createDataFrame(
        [(0.0, "x" * 70), (-0.0, "x" * 71), (float("nan"), "x" * 70), (None, None)], "d double, s string"
    )
    assert rows(distinct_counts(frame), "position") == [(0, "d", 1), (1, "s", 2)]


def bars(spark, categories, counting="decisive"):
    frame = spark.range(60).select((F.col("id") % categories).cast("string").alias("c"), F.col("id").alias("x"))
    return rc.recommend_generic(catalogue_roles({"t": frame}, counting)).orderBy("rank").collect()


def test_bar_rule_limit(spark):
    assert [r["plot_type"] for r in bars(spark, 14)] == ["histogram", "bar"]
    assert [r["plot_type"] for r in bars(spark, 15)] == ["histogram"]


def test_generic_charts_of_many_tables(spark):
    wide = spark.range(10).select(
        F.lit("a").alias("text"), *[F.col("id").alias(f"n{i}") for i in range(5)],
        F.timestamp_seconds("id").alias("t"), (F.col("id") > 3).alias("flag"),
    )
    tables = {"wide": wide, "empty": wide.filter("n0 < 0"), "texts": wide.select("text")}
    got = rc.recommend_generic(catalogue_roles(tables)).orderBy("table_name", "rank").collect()
    assert [(r["table_name"], r["rank"], r["title"]) for r in got] == [
        ("wide", 1, "Distribution of n0"), ("wide", 2, "Distribution of n1"),
        ("wide", 3, "Distribution of n2"), ("wide", 4, "n0 Over Time"), ("wide", 5, "n0 by text"),
    ]
    specs = rc.specs_of(rc.recommend_generic(catalogue_roles({"wide": wide})), "wide")
    assert specs[3] == ChartSpec("n0 Over Time", "line", ["t", "n0"], "Shows n0 trends over time")
    assert ch.chart_data(wide, specs[4]).columns == ["text", "mean"]
    assert len(ch.charts(wide, specs)) == 5


@pytest.mark.parametrize(
    "names, kinds",
    [
        (["n0", "n1", "n2", "n3", "t", "text"], ["histogram:n0", "line:t,n0", "histogram:n2"]),
        (["n0", "n1", "text"], ["histogram:n0", "bar:text,n0"]),
        (["n0", "n1", "n2"], ["histogram:n0", "scatter:n0,n1", "histogram:n2"]),
        (["n0"], ["histogram:n0"]),
        (["flag", "text"], ["histogram:flag", "bar:text,flag"]),
        (["text"], []),
    ],
)
def test_role_charts(spark, names, kinds):
    frame = spark.range(10).select(
        F.lit("a").alias("text"), *[F.col("id").alias(f"n{i}") for i in range(4)],
        F.timestamp_seconds("id").alias("t"), (F.col("id") > 3).alias("flag"),
    ).select(*names)
    got = rc.recommend_by_role(catalogue_roles({"t": frame})).orderBy("rank").collect()
    assert [f"{r['plot_type']}:{','.join(r['columns'])}" for r in got] == kinds


def test_fallback_leaves_flags_out(spark):
    frame = spark.range(3).select((F.col("id") > 1).alias("flag"), F.col("id").alias("n"))
    got = rc.recommend_fallback(catalogue_roles({"t": frame})).collect()
    assert [r["title"] for r in got] == ["Distribution of n"]


def test_histogram_refuses_infinite_values(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (2.0,)], "x double")
    with pytest.raises(Exception, match="infinite"):
        ch.histogram(df, "x").collect()
