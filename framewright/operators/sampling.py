"""Preview and fixed-size sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.columns import col, require_columns
from framewright.functions.fixed_values import PREVIEW_ROWS, SAMPLE_ROWS, SAMPLE_SEED


def head(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by an explicit key: a top-n, never a full sort."""
    require_columns(df, order_by)
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def sample_records(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as JSON records."""
    return head(df, order_by, n).select(F.to_json(F.struct("*")).alias("record"))


def sample_rows(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    n: int = SAMPLE_ROWS,
    seed: int = SAMPLE_SEED,
) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones on every run.

    Rows are ranked by a seeded hash of their key; each task keeps its best
    ``n``. Without a key the whole row is hashed, so equal rows rank together.
    Rows of equal keys are ranked by their content.
    """
    keys = list(keys or df.columns)
    require_columns(df, keys)
    text = F.concat_ws("#", *[col(c).cast("string") for c in keys], F.lit(str(seed)))
    content = F.to_json(F.struct(*[col(c) for c in df.columns]))
    return df.orderBy(F.md5(text), content).limit(n)
