"""Filters, aggregate menu, order look-up, relationships, plain SQL."""

import math

import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewright import Intent, custom_query, run_intent
from framewright.operators import querying as qu
from framewright.operators.aggregates import AGGREGATES

DATA = [
    ("a", 5.0, "x", True, 1), ("a", 5.0, "", False, 2), ("a", 5.0, None, True, 3),
    ("b", None, "y", True, 4), ("b", None, None, True, 5), ("c", 1.0, None, False, 6),
    ("d", -2.0, "p", None, 7), ("d", 3.5, "q", True, 8), ("d", 8.0, "q", False, 9), ("d", 0.0, "r", False, 10),
    (None, 7.0, "z", True, 11),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(DATA, "k string, v double, s string, b boolean, i int").cache()


def test_filters(spark):
    data = [("Red Ring", 1, True, 1.0), ("blue (x)", 2, False, 2.5), (None, 3, None, None), ("RED", 2, True, 2.0)]
    frame = spark.createDataFrame(data, "s string, n int, f boolean, d double")

    def names(filters, **options):
        return [r[1] for r in rows(qu.apply_filters(frame, filters, **options), "n", "s")]

    assert names({"s": "red"}) == [1, 2]
    assert names({"s": "^red$|ring"}) == [1, 2]
    assert names({"s": "(x)"}, literal=True) == [2]
    assert names({"n": 2}) == [2, 2]
    assert names({"n": 2, "s": "red", "unknown": 9}) == [2]
    assert names({"n": "2"}) == [2, 2]
    assert names({"s": 2}) == []
    assert names({"f": True}) == names({"f": 1}) == [1, 2]
    assert names({"d": 2.5}) == [2]
    assert names({"n": True}) == [1]
    assert names({"s": "an"}) == []
    assert names({"s": "an"}, match_null_text=True) == [3]
    assert names({}) == [1, 2, 2, 3]


@pytest.mark.parametrize("function", [*AGGREGATES, "median"])
@pytest.mark.parametrize("column", ["v", "b"])
def test_menu_equals_pandas(frame, function, column):
    table = pd.DataFrame(DATA, columns=["k", "v", "s", "b", "i"])
    if column == "b":
        table = table.dropna(subset=["b"])
        table["b"] = table["b"].astype(bool)
    source = frame.filter("b IS NOT NULL") if column == "b" else frame
    want = table.groupby(["k"]).agg({column: function})[column]
    got = {r["k"]: r[column] for r in qu.group_aggregate(source, ["k"], [column], function, "i").collect()}
    assert list(got) == sorted(want.index)
    for key, value in want.items():
        if isinstance(value, float) and math.isnan(value):
            assert got[key] is None
        else:
            assert got[key] == pytest.approx(value, abs=1e-9), key


@pytest.mark.parametrize("function", ["count", "nunique", "size", "any", "all", "min", "max", "first", "last"])
def test_menu_on_text(frame, function):
    got = dict(rows(qu.group_aggregate(frame, ["k"], ["s"], function, "i")))
    want = {
        "count": {"a": 2, "b": 1, "c": 0, "d": 4},
        "nunique": {"a": 2, "b": 1, "c": 0, "d": 3},
        "size": {"a": 3, "b": 2, "c": 1, "d": 4},
        "any": {"a": True, "b": True, "c": False, "d": True},
        "all": {"a": False, "b": True, "c": True, "d": True},
        "min": {"a": "", "b": "y", "c": None, "d": "p"},
        "max": {"a": "x", "b": "y", "c": None, "d": "r"},
        "first": {"a": "x", "b": "y", "c": None, "d": "p"},
        "last": {"a": "", "b": "y", "c": None, "d": "r"},
    }
    assert got == want[function]


def test_bad_aggregates(frame):
    with pytest.raises(TypeError):
        qu.group_aggregate(frame, ["k"], ["s"], "mean")
    with pytest.raises(ValueError):
        qu.group_aggregate(frame, ["k"], ["v"], "no such")
    with pytest.raises(ValueError):
        qu.group_aggregate(frame, ["k"], ["v"], "first")
    with pytest.raises(ValueError):
        qu.group_aggregate(frame, ["k"], ["gone"], "sum")
    with pytest.raises(ValueError):
        run_intent(frame, Intent("dance"))


def test_no_aggregation_without_value_columns(frame):
    assert run_intent(frame, Intent("aggregate", ["k"], {}, "sum", ["k"])).data.count() == len(DATA)
    assert run_intent(frame, Intent("aggregate", ["v"], {}, "sum", [])).data.count() == len(DATA)
    answer = run_intent(frame, Intent("trend", ["k", "v", "i"], {}, "sum", ["k"]))
    assert answer.data.columns == ["k", "v", "i"]
    assert answer.chart.plot_type == "line" and answer.chart.columns == ["k", "v"]


def test_default_intent():
    assert Intent.from_record({}) == Intent("filter", [], {}, None, [])
    assert Intent() == Intent("filter", (), {}, "count", ())


def test_order_lookup(spark):
    lines = spark.createDataFrame([(42, "a"), (42, "b"), (7, "c")], "order_id bigint, item string")
    answer = qu.order_lookup(lines, "Which items BELONG to sales order 42, or 7?")
    assert rows(answer.data, "item") == [(42, "a"), (42, "b")]
    assert answer.explanation == "Found 2 order lines for sales order 42"
    assert answer.chart.columns == ["item"]
    as_text = lines.withColumn("order_id", F.col("order_id").cast("string"))
    assert qu.order_lookup(as_text, "related to sales order 7").data.count() == 1
    assert qu.order_lookup(lines, "related to sales order 007").data.count() == 0
    assert qu.order_lookup(lines, "what is sales order 42?") is None
    assert qu.order_lookup(lines, "related to sales order x") is None
    assert qu.order_lookup(lines.toDF("x", "y"), "related to sales order 7") is None


def test_order_counts_for_many_questions(spark):
    lines = spark.createDataFrame([(1,)] * 5 + [(2,)], "order_id bigint")
    asked = [(i, "Lines related to sales order 1") for i in range(900)]
    asked += [(1000, "related to sales order 2"), (1001, "related to sales order 3"), (1002, "hello 1")]
    asked += [(2000 + i, f"associated with sales order {i}") for i in range(10, 1500)]
    questions = spark.createDataFrame(asked, "q int, question string")
    got = {r["q"]: (r["order_id"], r["line_count"]) for r in qu.order_line_counts(lines, questions, "question").collect()}
    assert len(got) == len(asked)
    assert all(got[i] == ("1", 5) for i in range(900))
    assert got[1000] == ("2", 1) and got[1001] == ("3", 0) and got[1002] == (None, None)
    assert got[2010] == ("10", 0)


def test_relationship(spark):
    frame = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 7.0), (None, 1.0), (3, None)], "x int, y double")
    groups, strength = qu.relationship(frame, "x", "y")
    assert rows(groups) == [(1, 3.0, 2), (2, 7.0, 1)]
    assert strength.first()["n"] == 3
    constant = spark.createDataFrame([(1, 2.0), (1, 4.0)], "x int, y double")
    assert qu.relationship(constant, "x", "y")[1].first()["pearson"] is None
    named = spark.createDataFrame([("a", 2.0)], "x string, y double")
    assert rows(qu.relationship(named, "x", "y")[0]) == [("a", 2.0, 1)]


def test_custom_query(frame):
    assert custom_query(frame, "SELECT count(*) AS n FROM data WHERE k = 'd'").first()["n"] == 4
    assert qu.project(frame, ["s", "k"]).columns == ["s", "k"]


def test_code_blocks(spark):
    from framewright.functions.text import code_block, without_code

    reply = "Text before.\n```python\nx = 1\nprint(x)\n```\nafter ```python y ``` end\n"
    frame = spark.createDataFrame([(reply,), ("plain",)], "t string")
    assert rows(frame.select(code_block(F.col("t")), without_code(F.col("t")))) == [
        ("x = 1\nprint(x)", "Text before.\n\nafter  end"),
        (None, "plain"),
    ]


def test_whole_doubles_are_order_ids(spark):
    from framewright.operators.querying import order_line_counts, order_lookup

    lines = spark.createDataFrame([(42.0,), (None,), (42.0,), (7.5,)], "order_id double")
    question = "lines that belong to sales order 42"
    assert order_lookup(lines, question).data.count() == 2
    asked = spark.createDataFrame([(question,)], "q string")
    assert order_line_counts(lines, asked, "q").first()["line_count"] == 2


def test_float_columns_meet_decimal_literals(spark):
    from framewright.operators.querying import apply_filters

    df = spark.createDataFrame([(0.1,), (0.2,)], "f float")
    assert apply_filters(df, {"f": 0.1}).count() == 1
