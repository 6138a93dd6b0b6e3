"""Tabular analytics on PySpark DataFrames."""

from framewright.operators.querying import ChartSpec, Intent, custom_query, run_intent
from framewright.operators.sales import sales_report
from framewright.plans.explore import answer_with_chart, explore
from framewright.plans.load import load
from framewright.session import build_session
from framewright.sources.tables import convert_to_csv, read_table

__all__ = [
    "ChartSpec",
    "Intent",
    "answer_with_chart",
    "build_session",
    "convert_to_csv",
    "custom_query",
    "explore",
    "load",
    "read_table",
    "run_intent",
    "sales_report",
]
