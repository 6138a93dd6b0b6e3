"""Order look-ups over the written layout, and lines reduced to pixels."""

import datetime as dt
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewright.operators.charting import time_series
from framewright.operators.querying import order_lookup, write_order_layout


def scanned(df):
    """Rows that the scan handed over: whole row groups, less what was skipped."""
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("as_text", [False, True])
def test_look_up_reads_few_rows(spark, tmp_path, as_text):
    number = (F.col("id") * 7919 % 20_011).alias("n")
    order = F.col("n").cast("string") if as_text else F.col("n")
    lines = spark.range(120_000).select(number, F.col("id").alias("line")).select(order.alias("order_no"), "line")
    path = str(tmp_path / "layout")
    write_order_layout(lines, path, row_group_bytes=1 << 16)
    found = order_lookup(spark.read.parquet(path), "lines related to sales order 4711").data
    want = sorted(r["line"] for r in lines.filter(F.col("order_no") == "4711").collect())
    assert [r["line"] for r in sorted(found.collect())] == want and len(want) >= 5
    assert scanned(found) < 120_000 / 5
    absent = order_lookup(spark.read.parquet(path), "lines related to sales order 30000").data
    assert absent.collect() == [] and scanned(absent) < 120_000 / 5


def test_an_order_of_very_many_lines_fills_several_files(spark, tmp_path):
    lines = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 4).otherwise(F.col("id")).alias("order_no"), "id")
    path = str(tmp_path / "layout")
    # Small partitions are left as they are, as they would be with much data.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_order_layout(lines, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r[0] for r in spark.read.parquet(path).filter("order_no = 4").groupBy(F.col("_metadata.file_path")).count().select("count").collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


def shown(points, pixels):
    """Brute force: first, last, lowest and highest of each column."""
    points = [p for p in points if None not in p]
    lo, hi = min(p[0] for p in points), max(p[0] for p in points)
    columns = {}
    for p in points:
        c = min(int((p[0] - lo) / ((hi - lo) / pixels)), pixels - 1) if hi > lo else 0
        columns.setdefault(c, []).append(p)
    kept = set()
    for c in columns.values():
        kept |= {min(c), max(c), min(c, key=lambda p: (p[1], p[0])), max(c, key=lambda p: (p[1], p[0]))}
    return sorted(kept)


@pytest.mark.parametrize("pixels", [1, 7, 100])
def test_pixels_like_brute_force(spark, pixels):
    rng = random.Random(pixels)
    points = [(rng.choice([None, *range(300)]), rng.choice([None, *range(5)])) for _ in range(900)]
    df = spark.createDataFrame(points, "`t.x` bigint, `v y` int")
    assert rows(time_series(df, "t.x", "v y", pixels=pixels)) == shown(points, pixels)


def test_pixels_of_dates_one_time_and_nothing(spark):
    start = dt.datetime(2024, 1, 1)
    points = [(start + dt.timedelta(minutes=i * i), float(i % 13)) for i in range(200)]
    df = spark.createDataFrame(points, "t timestamp_ntz, v double")
    numbers = [((t - start) // dt.timedelta(microseconds=1), v) for t, v in points]
    want = [(start + dt.timedelta(microseconds=x), v) for x, v in shown(numbers, 10)]
    assert rows(time_series(df, "t", "v", pixels=10)) == want
    one = spark.createDataFrame([(start, 1.0), (start, 3.0), (start, 2.0)], "t timestamp, v double")
    assert [r[1] for r in rows(time_series(one, "t", "v", pixels=5))] == [1.0, 3.0]
    assert time_series(df.limit(0), "t", "v", pixels=5).collect() == []


def test_pixels_refuse(spark):
    text = spark.createDataFrame([("a", 1)], "t string, v int")
    with pytest.raises(TypeError):
        time_series(text, "t", "v", pixels=5)
    with pytest.raises(ValueError):
        time_series(text, "v", "v", "day", 5)
    endless = spark.createDataFrame([(float("inf"), 1)], "t double, v int")
    with pytest.raises(Exception, match="infinite"):
        time_series(endless, "t", "v", pixels=5).collect()
