"""Duplicate rows by fingerprints: the same rows as a comparison of whole rows."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewright.operators import duplicates as du
from framewright.operators.cleaning import drop_duplicates, duplicate_count
from framewright.plans.load import clean_and_encode

SCHEMA = "a double, b string, `c.d` array<string>, e struct<x: int, y: string>, f timestamp_ntz, _print int"


def table(spark, n, seed, copies=0.3):
    rng = random.Random(seed)
    odd = [0.0, -0.0, float("nan"), None, 1.5]

    def row():
        return (rng.choice(odd), rng.choice(["", "x", None, "é"]), rng.choice([None, [], ["a", None], ["a"]]),
                rng.choice([None, (1, None), (None, "1"), (None, None)]), None, rng.choice([None, 1]))

    made = [row() for _ in range(n)]
    return spark.createDataFrame(made + rng.choices(made, k=int(copies * n)), SCHEMA)


def shown(df):
    return sorted(str(tuple(r)).replace("-0.0", "0.0") for r in df.collect())


@pytest.mark.parametrize("limit", [0, du.BROADCAST_REPEATED])
def test_like_whole_rows(spark, limit):
    df = table(spark, 400, 1)
    got = du.remove_duplicates(df, broadcast_repeated=limit)
    want = df.distinct()
    assert shown(got.data) == shown(want)
    assert got.removed == df.count() - want.count() > 0
    assert du.count_duplicates(df, limit).first()[0] == got.removed


def test_nulls_in_other_places_are_other_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None), (None, None)], "x string, y string")
    got = du.remove_duplicates(df)
    assert (got.removed, got.data.count()) == (1, 3)


def test_equal_fingerprints_are_not_enough(spark, monkeypatch):
    """With one fingerprint for all rows, equality of the cells still decides."""
    monkeypatch.setattr(du, "_prints", lambda names: [F.lit(1).alias(p) for p in du._PRINTS])
    df = table(spark, 50, 2)
    assert shown(du.remove_duplicates(df).data) == shown(df.distinct())
    assert du.count_duplicates(df).first()[0] == df.count() - df.distinct().count()


def test_order_key_of_the_first_copy(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (5, None), (4, None)], "k int, v string")
    for limit in (0, 10):
        assert rows(du.remove_duplicates(df, "k", limit).data, "k") == [(1, "x"), (2, "y"), (4, None)]


def test_maps_empty_tables_and_no_copies(spark):
    with pytest.raises(Exception, match="MAP"):
        du.remove_duplicates(spark.sql("SELECT map('a', id % 2) AS m FROM range(6)"))
    nothing = spark.createDataFrame([], "a int, b string")
    assert du.remove_duplicates(nothing).data.collect() == [] and duplicate_count(nothing).first()[0] == 0
    assert du.remove_duplicates(spark.range(7)).removed == 0


def test_whole_rows_are_not_shuffled(spark):
    """On wide rows with few copies the shuffles carry fingerprints, and the result none."""
    wide = spark.range(2000).select("id", *[F.repeat(F.lit("z"), 500).alias(f"t{i}") for i in range(10)])
    df = wide.unionAll(wide.filter("id < 3"))
    data = drop_duplicates(df)
    assert data.count() == 2000
    assert "Exchange hashpartitioning" not in data._jdf.queryExecution().executedPlan().toString()
    printed = df.select(*du._prints(df.columns)).groupBy(*du._PRINTS).count()
    exchange = [x for x in printed._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert exchange and not any("t0" in x for x in exchange)


def test_report_counts_without_a_pass(spark):
    df = spark.createDataFrame([("x", 1.5), ("x", 1.5), ("y", None)], "a string, b double")
    loaded = clean_and_encode(df)
    assert "LocalTableScan" in loaded.report._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in loaded.report._jdf.queryExecution().executedPlan().toString()
    removed = {r["metric"]: r["value"] for r in loaded.report.collect()}
    assert removed["rows_removed"] == "1"
    kept = clean_and_encode(df, dedupe=False).report.filter("metric = 'rows_removed'").first()["value"]
    lazy = clean_and_encode(df, materialise=False).report.filter("metric = 'rows_removed'").first()["value"]
    assert (kept, lazy) == ("0", "1")
