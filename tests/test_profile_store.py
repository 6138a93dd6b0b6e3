"""Profiles per file, merged: exact parts equal the profile at once, estimates stay near."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewright.operators import profile_store as ps
from framewright.operators.profiling import profile

EXACT = ["position", "column", "dtype", "row_count", "column_count", "missing_count", "min", "max"]


def frame(spark, low, high):
    i = F.col("id")
    return spark.range(low, high).select(
        i.alias("a.b"),
        F.when(i % 7 != 0, (i * 37 % 10_000) / 8).alias("d"),
        F.when(i % 5 == 0, F.lit(float("nan"))).otherwise(i.cast("double")).alias("n"),
        (i % 300).cast("string").alias("t"),
        (i % 2 == 0).alias("flag"),
        (i * 3 / 100).cast("decimal(12,2)").alias("money"),
        F.lit(None).cast("int").alias("nothing"),
    )


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "data"), str(tmp_path / "store")


def test_an_append_reads_new_files_only(spark, paths):
    data, store = paths
    frame(spark, 0, 4000).repartition(3).write.parquet(data)
    assert len(ps.update_profiles(spark, data, store)) == 3
    assert ps.update_profiles(spark, data, store) == []
    frame(spark, 4000, 9000).coalesce(1).write.mode("append").parquet(data)
    assert len(ps.update_profiles(spark, data, store)) == 1
    whole = spark.read.parquet(data)
    merged = ps.table_profile(spark, data, store)
    once = profile(whole)
    assert rows(merged.select(*EXACT), "position") == rows(once.select(*EXACT), "position")
    means = [(r["column"], r["mean"]) for r in merged.orderBy("position").collect()]
    want = [(r["column"], r["mean"]) for r in once.orderBy("position").collect()]
    assert [m[0] for m in means] == [w[0] for w in want]
    assert [m[1] for m in means] == pytest.approx([w[1] for w in want])
    # The profile comes from the store; the data is not opened.
    assert "a.b" not in merged._jdf.queryExecution().executedPlan().toString()


def test_estimates_are_near(spark, paths):
    data, store = paths
    frame(spark, 0, 20_000).repartition(7).write.parquet(data)
    ps.update_profiles(spark, data, store)
    got = {r["column"]: r for r in ps.table_profile(spark, data, store).collect()}
    whole = spark.read.parquet(data)
    for name, c in (("a.b", "`a.b`"), ("d", "d"), ("t", "t"), ("money", "money")):
        exact = whole.agg(F.count_distinct(c)).first()[0]
        assert got[name]["distinct_count"] == pytest.approx(exact, rel=0.06)
    for name, c in (("a.b", "`a.b`"), ("d", "d"), ("money", "money")):
        below, present = whole.agg(F.count_if(F.col(c).cast("double") <= got[name]["median"]), F.count(c)).first()
        assert below / present == pytest.approx(0.5, abs=0.02)
    assert got["nothing"]["median"] is None and got["nothing"]["distinct_count"] == 0
    assert got["t"]["median"] is None and got["flag"]["mean"] is None


def test_changed_and_removed_files(spark, paths):
    data, store = paths
    frame(spark, 0, 100).coalesce(1).write.parquet(data)
    ps.update_profiles(spark, data, store)
    frame(spark, 0, 40).coalesce(1).write.mode("overwrite").parquet(data)
    assert len(ps.update_profiles(spark, data, store)) == 1
    assert {r["row_count"] for r in ps.table_profile(spark, data, store).collect()} == {40}


def test_other_formats_and_merging_in_any_order(spark, tmp_path):
    data = str(tmp_path / "json")
    spark.range(50).repartition(4).write.json(data)
    found = ps.update_profiles(spark, data, str(tmp_path / "store"), "json")
    assert len(found) == 4
    (row,) = ps.table_profile(spark, data, str(tmp_path / "store")).collect()
    assert (row["row_count"], row["min"], row["max"], row["mean"]) == (50, 0.0, 49.0, 24.5)
