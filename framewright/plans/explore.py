"""Overview of a loaded frame: counts, preview, profile, charts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from framewright.operators.charting import chart_data
from framewright.operators.profiling import (
    column_information,
    column_roles,
    formatted_statistics,
    numeric_summary,
    profile,
    row_and_column_count,
)
from framewright.operators.querying import Answer, Intent, run_intent
from framewright.operators.recommending import recommend_by_role, recommend_generic
from framewright.operators.sampling import sample_records


class Overview(NamedTuple):
    shape: DataFrame
    sample: DataFrame
    information: DataFrame
    profile: DataFrame
    statistics: DataFrame
    generic_charts: DataFrame
    role_charts: DataFrame


def explore(df: DataFrame, order_by: Sequence[str], approx: bool = False) -> Overview:
    """Everything shown for a frame; ``approx`` keeps it to sketches."""
    roles = column_roles(df, counting="approx" if approx else "decisive")
    summary = numeric_summary(df, approx)
    return Overview(
        row_and_column_count(df),
        sample_records(df, order_by),
        column_information(df),
        profile(df, approx, summary),
        formatted_statistics(df, approx, summary),
        recommend_generic(roles),
        recommend_by_role(roles),
    )


def answer_with_chart(df: DataFrame, intent: Intent) -> tuple[Answer, DataFrame | None]:
    """Run an intent and build the table behind the chart it asks for."""
    answer = run_intent(df, intent)
    if answer.chart is None:
        return answer, None
    return answer, chart_data(answer.data, answer.chart)
