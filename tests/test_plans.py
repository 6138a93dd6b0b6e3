"""Plan shapes: no Python in the hot path, pushed filters, pre-aggregation."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from check_oracle import compare, connect
from framewright import explore
from framewright.operators import charting as ch
from framewright.operators import cleaning as cl
from framewright.operators import querying as qu

PYTHON_NODES = ("PythonUDF", "MapInPandas", "BatchEvalPython", "ArrowEvalPython")
PRODUCT_NODES = ("CartesianProduct", "NestedLoop")
# The workbook scan is the only operator that needs Python in its tasks.
WITH_PYTHON = {"xlsx_folder"}


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return entry_module.table(spark, sf_dir, "orders")


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["o_orderpriority", "o_totalprice"]
    assert df.count() == 2


def test_every_query_has_an_oracle():
    assert set(entry_module._QUERIES) == set(entry_module._ORACLES)
    assert set(entry_module._QUERIES) <= set(entry_module.queries())


def test_queries_match_oracle(spark, sf_dir):
    """Equal results; no Python and no products of rows in the plans."""
    con = connect(sf_dir)
    oracles = entry_module._ORACLES
    bad = {}
    for name, build in entry_module._QUERIES.items():
        df = build(spark, sf_dir)
        text = plan(df)
        found = [n for n in PRODUCT_NODES if n in text]
        if name not in WITH_PYTHON:
            found += [n for n in PYTHON_NODES if n in text]
        difference = compare(con, df, oracles[name])
        if difference or found:
            bad[name] = difference or found
    assert not bad


def test_filter_and_columns_reach_the_scan(orders):
    text = plan(qu.run_intent(orders, qu.Intent("aggregate", ["o_totalprice"], {"o_orderkey": 7}, "mean",
                                                ["o_orderpriority"])).data)
    assert "EqualTo(o_orderkey,7)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in text


def test_aggregates_combine_before_the_shuffle(orders):
    for function in ("sum", "mean", "std", "skew", "first", "any"):
        df = qu.group_aggregate(orders, ["o_orderstatus"], ["o_totalprice"], function, "o_orderkey")
        text = plan(df)
        assert "partial_" in text and "SortAggregate" not in text, function


def test_distinct_shuffles_on_key_and_value(orders):
    text = plan(qu.group_aggregate(orders, ["o_orderstatus"], ["o_custkey"], "nunique"), "simple")
    assert "hashpartitioning(o_orderstatus#" in text
    assert text.count("o_custkey#", text.index("hashpartitioning")) > 0


def test_top_k_needs_no_sort(orders):
    assert "TakeOrderedAndProject" in plan(ch.top_values(orders, "o_custkey"))


def test_imputation_reads_means_once(orders):
    gaps = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")))
    text = plan(cl.impute_means(gaps).select("o_totalprice"))
    assert "partial_sum" in text or "partial_avg" in text
    assert "avg(o_custkey" not in text


def test_explore(orders):
    overview = explore(orders, ["o_orderkey"])
    assert overview.shape.first()["column_count"] == 6
    assert overview.sample.count() == 5
    assert overview.information.count() == overview.profile.count() == 6
    assert overview.statistics.count() == 3
    assert overview.generic_charts.count() == 5
    assert overview.role_charts.count() == 3
    assert explore(orders, ["o_orderkey"], approx=True).profile.count() == 6


def test_library_never_checkpoints_locally():
    for path in Path(entry_module.__file__).parent.glob("framewright/**/*.py"):
        names = {n.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & {"localCheckpoint", "toPandas", "crossJoin", "rdd", "cache", "persist"}, path
