"""Boundaries of type inference and cleaning."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewright.operators import cleaning as cl
from framewright.operators import inference as inf
from framewright.plans.load import clean_and_encode


def texts(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` string")


def kind_of(spark, values, raw_text=False):
    return inf.infer_types(texts(spark, values), raw_text)[1][0]


def test_exactly_half_missing_is_kept(spark):
    frame = spark.createDataFrame(
        [(None if i < 5 else "x", None if i < 6 else "x", i) for i in range(10)],
        "a string, b string, k int",
    )
    assert cl.drop_sparse(frame).columns == ["a", "k"]
    assert rows(cl.sparse_columns(frame)) == [("b", "60.0")]


@pytest.mark.parametrize(
    "numbers, others, nulls, kind",
    [
        (80, 20, 0, "text"),
        (81, 19, 0, "double"),
        (80, 0, 20, "text"),
        (81, 0, 19, "double"),
        (100, 0, 0, "bigint"),
    ],
)
def test_share_of_numbers(spark, numbers, others, nulls, kind):
    values = [str(i) for i in range(numbers)] + ["x"] * others + [None] * nulls
    assert kind_of(spark, values).kind == kind


def test_untyped_source_needs_only_present_numbers(spark):
    assert kind_of(spark, ["1", None, None], raw_text=True).kind == "double"
    assert kind_of(spark, ["1", "2"], raw_text=True).kind == "bigint"
    assert kind_of(spark, ["1", "x", None], raw_text=True).kind == "text"


@pytest.mark.parametrize(
    "text, value",
    [
        (" 1 ", 1.0), ("1e5", 1e5), ("1.", 1.0), (".5", 0.5), ("+1", 1.0), ("-1", -1.0),
        ("\t2\n", 2.0), ("iNf", float("inf")), ("-Infinity", float("-inf")),
        ("9" * 25, 1e25), ("1d", None), ("1f", None), ("1.0d", None), ("0x10", None),
        ("1,000", None), ("1_000", None), ("", None), ("   ", None), ("1e", None), ("e5", None),
        (".", None), ("+", None), ("--1", None), ("1 2", None), ("True", None),
        ("1.5e400", None), ("nan", None), ("1.0.0", None),
    ],
)
def test_number_texts(spark, text, value):
    from framewright.functions.text import number_from_text

    assert texts(spark, [text]).select(number_from_text(F.col("v"))).first()[0] == value


@pytest.mark.parametrize(
    "values, spark_format",
    [
        (["13/02/2024", "01/02/2024"], "d/M/yyyy"),
        (["02/13/2024", "01/02/2024"], "M/d/yyyy"),
        (["01/02/2024"], "d/M/yyyy"),
        (["2024-01-15 10:00:00"], "yyyy-M-d H:m:s"),
        (["2024-01-15", None], "yyyy-M-d"),
        (["2024/01/15"], "yyyy/M/d"),
        (["13-02-2024"], "d-M-yyyy"),
        (["02-13-2024"], "M-d-yyyy"),
        (["2024-01-15"] * 9 + ["2024-02-30"], None),
        (["2024-01-15"] * 9 + ["2024-1-5"], "yyyy-M-d"),
        (["2024-1-5"] * 9 + ["2024-01-15"], None),
        (["2024-01-15"] * 9 + ["soon"], None),
        (["2024-01-15"] * 9 + ["7"], None),
        (["2024-01-15T10:00:00"], None),
        ([None, None], None),
    ],
)
def test_date_formats(spark, values, spark_format):
    decision = kind_of(spark, values)
    assert decision.date_format == spark_format
    assert decision.kind == ("timestamp" if spark_format else "text")


def test_ambiguous_dates_are_day_first(spark):
    typed, _ = inf.infer_types(texts(spark, ["01/02/2024"]))
    assert typed.first()[0] == dt.datetime(2024, 2, 1)


def test_free_dates_are_month_first(spark):
    assert inf.parse_dates(texts(spark, ["01/02/2024"]), "v").first()[0] == dt.datetime(2024, 1, 2)
    assert inf.parse_dates(texts(spark, ["13/02/2024", None]), "v").count() == 2
    with pytest.raises(ValueError):
        inf.parse_dates(texts(spark, ["2024-01-01", "soon"]), "v")


def test_flags(spark):
    assert kind_of(spark, ["True", "false", "TRUE"], raw_text=True).kind == "boolean"
    mostly = ["True"] * 9 + [None]
    typed, decisions = inf.infer_types(texts(spark, mostly), raw_text=True)
    assert decisions[0].kind == "flag_number"
    assert typed.agg(F.sum("v")).first()[0] == 9.0
    assert kind_of(spark, ["True"] * 8 + [None] * 2, raw_text=True).kind == "text"
    assert kind_of(spark, ["True", "x"], raw_text=True).kind == "text"


def test_duplicates(spark):
    frame = spark.createDataFrame(
        [(1, "a"), (1, "a"), (None, None), (None, None), (1, None), (1, "a")], "a int, b string"
    )
    once = cl.drop_duplicates(frame)
    assert once.count() == 3
    assert cl.drop_duplicates(once).count() == 3
    assert cl.duplicate_count(frame).first()[0] == 3
    keyed = spark.createDataFrame([(1, 9), (1, 4), (2, 7)], "a int, row int")
    assert rows(cl.drop_duplicates(keyed, "row"), "a") == [(1, 4), (2, 7)]


def test_names(spark):
    frame = spark.createDataFrame([(1, 2, 3, 4)], "` Order Date ` int, `A b` int, `a_b` int, `x.y` int")
    assert cl.normalise_names(frame).columns == ["order_date", "a_b", "a_b_1", "x.y"]
    assert rows(cl.drop_missing(frame, ["x.y"])) == [(1, 2, 3, 4)]


def test_currency(spark):
    frame = spark.createDataFrame(
        [("$1,299.99", "abc", "$5", "x"), ("7", "1", None, "$1")],
        "`Total Sales` string, price string, note string, other string",
    )
    named = cl.strip_currency_by_name(frame)
    assert rows(named) == [(1299.99, None, "$5", "x"), (7.0, 1.0, None, "$1")]
    assert rows(cl.strip_currency(frame)) == [(1299.99, None, 5.0, None), (7.0, 1.0, None, 1.0)]


def test_imputation(spark):
    frame = spark.createDataFrame(
        [(1.0, "a", 1), (None, None, None), (4.0, "b", 2), (float("nan"), "c", 6)],
        "x double, s string, n int",
    )
    assert rows(cl.impute_means(frame)) == [
        (1.0, "a", 1.0), (2.5, None, 3.0), (4.0, "b", 2.0), (2.5, "c", 6.0)
    ]


def test_drop_missing_counts_nan(spark):
    frame = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c")], "x double, s string")
    assert rows(cl.drop_missing(frame, ["x"])) == [(1.0, "a")]


def test_display_text(spark):
    frame = spark.sql(
        "SELECT timestamp_ntz'2024-01-02 03:04:05' AS t, timestamp'2024-01-02 03:04:05' AS z, "
        "CAST(NULL AS string) AS s, 1 AS n, CAST(NULL AS timestamp_ntz) AS m"
    )
    assert rows(cl.display_text(frame)) == [
        ("2024-01-02 03:04:05", "2024-01-02 03:04:05", "nan", 1, None)
    ]


def test_whole_cleaning_reports(spark):
    data = [("1", "x", None, "2024-01-01"), ("1", "x", None, "2024-01-01"), ("2", "y", "k", "2024-01-02"),
            ("3", "y", None, "2024-01-03")]
    frame = spark.createDataFrame(data, "`A N` string, tag string, gone string, day string")
    for materialise in (True, False):
        loaded = clean_and_encode(frame, raw_text=True, materialise=materialise)
        # Two values in three rows are too many to encode.
        assert loaded.data.columns == ["a_n", "tag", "day"]
        assert loaded.data.dtypes[0] == ("a_n", "bigint")
        assert loaded.data.count() == 3
        assert rows(loaded.report) == [
            ("drop_sparse", "gone", "missing_pct", "75.0"),
            ("drop_duplicates", None, "rows_removed", "1"),
        ]


def test_empty_frame(spark):
    frame = spark.createDataFrame([], "a string, n int")
    loaded = clean_and_encode(frame)
    assert loaded.data.columns[:2] == ["a", "n"]
    assert loaded.data.count() == 0


def test_means_leave_full_columns_alone(spark):
    from decimal import Decimal

    from framewright.operators.cleaning import impute_means

    big = 2**53 + 1
    df = spark.createDataFrame(
        [(big, Decimal("0.10"), 1), (big + 2, Decimal("0.20"), None), (5, Decimal("0.30"), 4)],
        "id bigint, price decimal(10,2), n int",
    )
    out = impute_means(df)
    assert out.dtypes == [("id", "bigint"), ("price", "decimal(10,2)"), ("n", "double")]
    assert [r["id"] for r in out.collect()] == [big, big + 2, 5]
    assert [r["n"] for r in out.collect()] == [1.0, 2.5, 4.0]


def test_free_date_forms(spark):
    import datetime as dt

    from framewright.operators.inference import json_types, parse_dates

    forms = {
        "2024-01-15T10:00:00": dt.datetime(2024, 1, 15, 10),
        "2024-01-15T10:00:00.250Z": dt.datetime(2024, 1, 15, 10, 0, 0, 250_000),
        "2024-1-5 7:30": dt.datetime(2024, 1, 5, 7, 30),
        "Jan 5, 2024": dt.datetime(2024, 1, 5),
        "5 January 2024": dt.datetime(2024, 1, 5),
    }
    for text, value in forms.items():
        assert parse_dates(spark.createDataFrame([(text,)], "d string"), "d").first()[0] == value
    typed = json_types(spark.createDataFrame([("2024-01-15T10:00:00",)], "datetime string"))
    assert typed.first()[0] == dt.datetime(2024, 1, 15, 10)


def date_texts(rng, date_format):
    """A text of the format, sometimes with a part out of range."""
    import re

    from framewright.operators.date_shapes import MONTHS

    def part(p):
        top = {"M": 14 if rng.random() < 0.05 else 12, "d": 31, "H": 25 if rng.random() < 0.02 else 23, "m": 59, "s": 59}
        if p in top:
            n = rng.randrange(1, top[p] + 1)
            return rng.choice([str(n), f"{n:02d}"])
        if p.startswith("S"):
            return str(rng.randrange(10 ** len(p))).zfill(len(p))
        fixed = {"yyyy": str(rng.randrange(1900, 2100)), "MMM": rng.choice(MONTHS)[:3], "MMMM": rng.choice(MONTHS)}
        return fixed.get(p, p.strip("'"))

    return "".join(part(m[0]) for m in re.finditer(r"'[^']*'|([A-Za-z])\\1*|.", date_format))


def test_free_formats_like_parsing_every_text(spark):
    """Shapes decide as if every text had been parsed by every format."""
    import random

    from framewright.functions.text import fits_date
    from framewright.operators.date_shapes import FREE_DATE_FORMATS, free_formats

    rng = random.Random(7)
    columns = {}
    for i, f in enumerate(FREE_DATE_FORMATS):
        for n in (1, 3):
            columns[f"c{i}_{n}"] = [date_texts(rng, f) for _ in range(n)] + [None] * (4 - n)
    odd = ["", "soon", "2024-01-01x", "2024-02-30", "0000-01-01", "Jan 5 2024", "JAN 5, 2024", "2024-01-01Q10:00", "1/1/24"]
    columns |= {f"odd{i}": [t, None, None, "2024-01-01"] for i, t in enumerate(odd)} | {"none": [None] * 4}
    df = spark.createDataFrame([*zip(*columns.values(), strict=True)], ", ".join(f"{n} string" for n in columns))
    found = free_formats(df, list(columns))
    counts = df.select(
        *[F.struct(F.count(c), *[F.count_if(fits_date(F.col(c), f)) for f in FREE_DATE_FORMATS]) for c in columns]
    ).first()
    for name, counted in zip(columns, counts, strict=True):
        want = next((f for f, n in zip(FREE_DATE_FORMATS, counted[1:], strict=True) if n == counted[0]), None)
        assert found[name] == want, (name, columns[name])


def test_dates_of_all_columns_by_one_aggregate(spark):
    rows = [("2024-01-05", "5 May 2024", "1/2/2024 3:04", 1), ("2024-1-6", "31 Dec 1999", None, 2)]
    df = spark.createDataFrame(rows, "`a.b` string, b string, c string, d int")
    got = inf.parse_dates(df, ["a.b", "b", "c"]).collect()
    assert [tuple(r) for r in got] == [
        (dt.datetime(2024, 1, 5), dt.datetime(2024, 5, 5), dt.datetime(2024, 1, 2, 3, 4), 1),
        (dt.datetime(2024, 1, 6), dt.datetime(1999, 12, 31), None, 2),
    ]
