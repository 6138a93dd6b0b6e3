"""Results worked out apart on the invented sales sample."""

import pytest
from helpers import rows

from framewright import Intent, load, run_intent, sales_report
from framewright.operators.charting import category_means, histogram, top_values, trend_line
from framewright.operators.cleaning import strip_currency
from framewright.operators.profiling import catalogue_roles, numeric_summary
from framewright.operators.querying import relationship
from framewright.operators.recommending import recommend_generic
from framewright.operators.sales import totals_text
from framewright.sources.delimited import read_csv
from framewright.operators.inference import infer_types
from sample import write_sample


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    return write_sample(tmp_path_factory.mktemp("sample"))


@pytest.fixture(scope="module")
def typed(spark, path):
    return infer_types(read_csv(spark, path), raw_text=True)[0].cache()


@pytest.fixture(scope="module")
def loaded(spark, path):
    return load(spark, path)


def test_inferred_types(typed):
    assert typed.dtypes == [
        ("Date", "timestamp_ntz"),
        ("Product", "string"),
        ("Category", "string"),
        ("Sales", "string"),
        ("Quantity", "bigint"),
    ]


def test_sales_report(typed):
    report = sales_report(typed)
    total, average = report.totals.first()
    assert total == pytest.approx(2967.55)
    assert average == pytest.approx(228.273077, abs=1e-6)
    assert [(c, round(s, 2)) for c, s in rows(report.top_categories)] == [
        ("Furniture", 2660.8),
        ("Kitchen", 306.75),
    ]
    assert [(m, round(s, 2)) for m, s in rows(report.monthly)] == [
        ("2023-05", 1211.75),
        ("2023-06", 1330.4),
        ("2023-07", 302.15),
        ("2023-08", 123.25),
    ]
    assert rows(totals_text(report.totals)) == [("$2,967.55", "$228.27")]


def test_sales_report_takes_text_dates(spark, path):
    months = sales_report(infer_quantity_only(spark, path)).monthly
    assert [m for m, _ in rows(months)] == ["2023-05", "2023-06", "2023-07", "2023-08"]


def infer_quantity_only(spark, path):
    return infer_types(read_csv(spark, path), raw_text=True, names=["Quantity"])[0]


def test_numeric_summary(typed):
    found = {r["column"]: r for r in numeric_summary(strip_currency(typed, ["Sales"])).collect()}
    assert found["Sales"]["median"] == pytest.approx(84.5)
    assert (found["Sales"]["min"], found["Sales"]["max"]) == (7.25, 1120.0)
    assert found["Quantity"]["mean"] == pytest.approx(64 / 13, abs=1e-6)
    assert (found["Quantity"]["median"], found["Quantity"]["max"]) == (4.0, 12.0)


def test_charts(typed):
    assert rows(category_means(typed, "Category", "Quantity")) == [
        ("Furniture", 2.8),
        ("Kitchen", 6.25),
    ]
    assert rows(top_values(typed, "Product")) == [
        ("Copper Kettle", 3),
        ("Oak Stool", 3),
        ("Tea Towel", 3),
        ("Egg Timer", 2),
        ("Wall Shelf", 2),
    ]
    bins = {b: n for b, _, _, n in rows(histogram(typed, "Quantity"))}
    assert {b: n for b, n in bins.items() if n} == {
        0: 2, 2: 2, 5: 1, 8: 2, 10: 1, 13: 1, 16: 1, 19: 1, 21: 1, 29: 1
    }
    assert len(bins) == 30


def test_trend_and_correlation(typed):
    numbers = strip_currency(typed, ["Sales"])
    slope, intercept, r2, n = trend_line(numbers, "Quantity", "Sales").first()
    assert (slope, intercept) == (pytest.approx(-49.746693), pytest.approx(473.179875))
    assert n == 13
    _, strength = relationship(numbers, "Quantity", "Sales")
    assert strength.first()["pearson"] == pytest.approx(-0.503939, abs=1e-6)
    assert r2 == pytest.approx(0.503939**2, abs=1e-5)


def test_load_cleans_and_encodes(loaded):
    assert loaded.data.columns == [
        "date", "product", "category", "sales", "quantity",
        "product_Egg Timer", "product_Oak Stool", "product_Tea Towel",
        "product_Wall Shelf", "category_encoded",
        "sales_$15.75", "sales_$210.40", "sales_$560.00", "sales_$7.25", "sales_$84.50",
    ]
    codes = loaded.data.select("category", "category_encoded").distinct()
    assert rows(codes, "category") == [("Furniture", 0), ("Kitchen", 1)]
    assert loaded.mapping["category"] == ["category_encoded"]
    assert rows(loaded.report) == [("drop_duplicates", None, "rows_removed", "1")]


def test_recommendations(loaded):
    charts = recommend_generic(catalogue_roles({"sales": loaded.data})).orderBy("rank")
    assert [(r["plot_type"], r["columns"]) for r in charts.collect()] == [
        ("histogram", ["quantity"]),
        ("histogram", ["category_encoded"]),
        ("line", ["date", "quantity"]),
        ("bar", ["product", "quantity"]),
    ]


def test_intent_on_sample(loaded):
    intent = Intent.from_record(
        {
            "intent": "aggregate",
            "parameters": {
                "columns": ["category", "quantity"],
                "filters": {"product": "STOOL|timer"},
                "aggregation": "sum",
                "groupby": ["category"],
            },
        }
    )
    answer = run_intent(loaded.data, intent)
    assert rows(answer.data) == [("Furniture", 5), ("Kitchen", 13)]
    assert answer.explanation == (
        "Filtered data where product=STOOL|timer. Grouped by category. "
        "Calculated sum of category, quantity."
    )
    assert answer.chart is None
