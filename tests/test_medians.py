"""Both median paths against pandas."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framewright.operators.medians import column_medians, grouped_median

SCHEMA = "k string, v double"


def expected(data):
    frame = pd.DataFrame(data, columns=["k", "v"])
    return {k: None if pd.isna(m) else m for k, m in frame.groupby("k")["v"].median().items()}


@pytest.mark.parametrize("ranked_values", [1, 50, 10**6])
def test_skewed_groups(spark, ranked_values):
    """One group holds most rows, one value most of another group."""
    data = [("hot", float(i * 7919 % 3001)) for i in range(3001)]
    data += [("tie", 5.0)] * 400 + [("tie", float(i)) for i in range(399)]
    data += [("one", 2.5), ("two", 1.0), ("two", 4.0), ("none", None), ("some", None), ("some", -3.0)]
    frame = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = grouped_median(frame, ["k"], ["v"], ranked_values)
    assert {r["k"]: r["v"] for r in got.collect()} == expected(data)


def test_two_values_and_two_keys(spark):
    frame = spark.createDataFrame(
        [(i % 2, i % 3, float(i), i * i) for i in range(60)], "a int, b int, x double, y int"
    )
    want = frame.toPandas().groupby(["a", "b"])[["x", "y"]].median()
    for limit in (1, 100):
        got = grouped_median(frame, ["a", "b"], ["x", "y"], limit).toPandas().set_index(["a", "b"])
        assert got.sort_index().to_dict() == want.astype(float).to_dict()


def test_columns(spark):
    frame = spark.createDataFrame([(1, 2.0, True), (5, None, False), (9, 4.0, True)], "i int, d double, f boolean")
    for limit in (1, 100):
        got = {r["column"]: r["median"] for r in column_medians(frame, ["i", "d", "f"], limit).collect()}
        assert got == {"i": 5.0, "d": 3.0, "f": 1.0}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(-9, 9).map(float))),
        min_size=1,
        max_size=40,
    )
)
def test_random_groups(spark, data):
    frame = spark.createDataFrame(data, SCHEMA)
    for limit in (1, 100):
        got = grouped_median(frame, ["k"], ["v"], limit)
        assert {r["k"]: r["v"] for r in got.collect()} == expected(data)


def test_keys_may_bear_any_name(spark):
    from framewright.operators.medians import grouped_median

    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0)], "v0 int, _median_of_0 string, x double")
    assert grouped_median(df, ["v0", "_median_of_0"], ["x"]).first()["x"] == 3.0


def test_only_the_brackets_are_written(spark, monkeypatch):
    """Of 40,000 distinct values a few hundred are counted; both rank paths agree."""
    import framewright.operators.medians as m

    sizes = []
    whole = m.reliable

    def watched(df, *args):
        out = whole(df, *args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(m, "reliable", watched)
    frame = spark.range(40_000).selectExpr("(id * 7919) % 40009 * 1.5 AS x", "id % 2 AS k")
    want = sorted(r["x"] for r in frame.collect())
    for limit in (10, 10**6):
        got = column_medians(frame, ["x"], limit).first()["median"]
        assert got == (want[19_999] + want[20_000]) / 2
    assert max(sizes) < 1_000


def test_a_bracket_that_misses_is_not_used(spark, monkeypatch):
    import framewright.operators.medians as m

    monkeypatch.setattr(m, "MARGIN", -0.3)
    frame = spark.range(101).selectExpr("id * 1.0D AS x")
    assert column_medians(frame, ["x"]).first()["median"] == 50.0
