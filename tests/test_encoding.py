"""Encoding choices, labels on both dictionary paths, one-hot."""

import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewright.operators import encoding as en


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")


@pytest.mark.parametrize(
    "distinct, n, kind",
    [(2, 40, "label"), (3, 40, "one_hot"), (10, 40, "one_hot"), (11, 40, "label"),
     (10, 20, "one_hot"), (11, 20, "none")],
)
def test_choice(spark, distinct, n, kind):
    frame = column(spark, [f"v{i % distinct}" for i in range(n)])
    assert [c.kind for c in en.encoding_plan(frame).choices] == [kind]


def test_mostly_missing_is_skipped(spark):
    frame = column(spark, ["a"] * 4 + [None] * 6)
    assert en.encoding_plan(frame).choices[0].kind == "none"
    assert en.encoding_plan(column(spark, ["a"] * 5 + [None] * 5)).choices[0].kind == "label"


def test_labels_follow_text_order(spark):
    frame = column(spark, ["b", "Z", "a", "b", "ä"])
    assert [r[2] for r in rows(en.label_encode(frame, "c"), "i")] == [2, 0, 1, 2, 3]


def test_missing_is_a_class_of_its_own(spark):
    frame = column(spark, ["b", "z", None, "b"])
    assert [r[2] for r in rows(en.label_encode(frame, "c"), "i")] == [0, 2, 1, 0]


def test_one_hot_missing_row_has_no_flag(spark):
    encoded = en.one_hot(column(spark, ["b", "a", None, "c"]), "c")
    assert encoded.columns == ["i", "c", "c_b", "c_c"]
    assert [r[2:] for r in rows(encoded, "i")] == [
        (True, False), (False, False), (False, False), (False, True)
    ]


def test_one_hot_has_at_most_one_flag(spark):
    encoded = en.encode(column(spark, [f"v{i % 7}" for i in range(70)])).data
    flags = [F.col(f"`{n}`").cast("int") for n in encoded.columns[2:]]
    assert len(flags) == 6
    assert encoded.select(sum(flags[1:], flags[0]).alias("n")).agg(F.max("n")).first()[0] == 1


def test_encode_mixes_missing_and_names(spark):
    data = [(f"k{i % 3}" if i % 4 else None, "yes" if i % 2 else "no", i) for i in range(24)]
    frame = spark.createDataFrame(data, "`a.b` string, flag string, flag_encoded int")
    encoded = en.encode(frame)
    assert encoded.mapping == {"a.b": ["a.b_k1", "a.b_k2"], "flag": ["flag_encoded_1"]}
    assert encoded.data.select("flag", "flag_encoded_1").distinct().count() == 2


@pytest.mark.parametrize("dictionary_rows", [1, 10_000])
def test_large_dictionary_equals_small(spark, dictionary_rows):
    """A third of all rows share one key; a sixth are missing."""
    values = [
        "hot" if i % 3 == 0 else None if i % 6 == 1 else f"k{i * 7919 % 1500:05d}" for i in range(6000)
    ]
    frame = column(spark, values).repartition(8)
    encoded = en.label_encode(frame, "c", dictionary_rows=dictionary_rows)
    classes = sorted({v if v is not None else "nan" for v in values})
    place = {k: i for i, k in enumerate(classes)}
    got = dict(encoded.select("i", "c_encoded").collect())
    assert got == {i: place[v if v is not None else "nan"] for i, v in enumerate(values)}


def test_substitution_uses_first_encoding(spark):
    frame = column(spark, [f"v{i % 3}" for i in range(30)])
    encoded = en.encode(frame)
    shown = en.substitute_encoded(encoded.data, encoded.mapping, ["c"], ["i"], max_rows=10)
    assert shown.count() == 10
    assert dict(shown.dtypes)["c"] == "boolean"


def test_shuffled_labels_spread_settled_rows(spark):
    """Rows settled by the broadcast part must not meet in one partition."""
    values = ["hot" if i % 3 else f"k{i}" for i in range(9000)]
    frame = column(spark, values)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        encoded = en.label_encode(frame, "c", dictionary_rows=1)
        text = encoded._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        )
        assert re.search(r"hashpartitioning\(_open_key#\d+, _spread#\d+L", text)
        classes = sorted(set(values))
        want = [classes.index(v) for v in values[:50]]
        assert [r["c_encoded"] for r in encoded.orderBy("i").limit(50).collect()] == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sample_comes_before_the_dictionary(spark):
    df = spark.range(500).selectExpr("id AS i", "concat('k', id % 200) AS c")
    plan = en.EncodingPlan([en.EncodingChoice("c", "label", None)], en.class_table(df, ["c"]))
    shown = en.encoded_sample(df, ["c"], ["i"], max_rows=10, plan=plan).collect()
    codes = {v: n for n, v in enumerate(sorted(f"k{j}" for j in range(200)))}
    assert len(shown) == 10
    assert all(r["c"] == codes[f"k{r['i'] % 200}"] for r in shown)


def test_hot_keys_of_any_length_are_looked_up_by_broadcast(spark):
    from framewright.operators.lookups import lookup_join

    long = "x" * 9_000
    df = spark.createDataFrame([(long,)] * 50 + [("a",), (None,), ("b" * 64,)], "k string")
    found = df.groupBy("k").count().selectExpr("k AS key", "length(k) AS value", "count AS occurrences")
    out = lookup_join(df, "k", found.filter("key IS NOT NULL"), "n").collect()
    assert sorted((r["n"] or 0) for r in out) == [0, 1, 64] + [9_000] * 50
