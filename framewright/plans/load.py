"""File to clean, typed, encoded frame."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.columns import col, local_rows, text_columns
from framewright.operators.cleaning import normalise_names, report_rows
from framewright.operators.duplicates import merge_equal, remove_duplicates
from framewright.operators.encoding import encode, encoding_plan
from framewright.operators.inference import (
    ColumnType,
    apply_types,
    decide_type,
    json_types,
    null_fractions,
    type_evidence,
)
from framewright.sources.delimited import ROW_ORDER
from framewright.sources.tables import read_table, source_format


class Loaded(NamedTuple):
    data: DataFrame
    types: list[ColumnType]
    mapping: dict[str, list[str]]
    report: DataFrame


def clean_and_encode(
    df: DataFrame, raw_text: bool = False, dedupe: bool = True, materialise: bool = True
) -> Loaded:
    """Drop sparse columns, infer types, remove duplicates, fix names, encode.

    Two small results reach the driver, one row per column each: the counts
    behind the types, and the classes of categorical columns.
    ``raw_text`` says that every column is untyped text (CSV, workbooks).
    ``materialise`` writes the rows once to the shared folder while duplicates
    are looked for, because the encoder reads them several times; without it
    everything is recomputed per read, and duplicates are merged by a shuffle
    of all columns.
    """
    order_key = ROW_ORDER if ROW_ORDER in df.columns else None
    names = [n for n in df.columns if n != order_key]
    texts = [n for n in text_columns(df) if n != order_key]
    others = [n for n in names if n not in texts]
    evidence = {e["column"]: e for e in type_evidence(df, texts).collect()} if texts else {}
    counts = {n: (e["row_count"], e["row_count"] - e["present"]) for n, e in evidence.items()}
    if others:
        typed_part = null_fractions(df.select(*[col(n) for n in others]))
        counts |= {r["column"]: (r["row_count"], r["missing_count"]) for r in typed_part.collect()}
    rows = max((r for r, _ in counts.values()), default=0)
    sparse = [n for n in names if n in counts and 2 * counts[n][1] > counts[n][0]]

    types = [decide_type(evidence[n], raw_text) for n in texts if n in evidence and n not in sparse]
    kept = df.select(*[col(n) for n in df.columns if n not in sparse])
    clean = apply_types(kept, types)
    if dedupe and not materialise:
        clean = merge_equal(clean, order_key)
        removed = clean.agg((F.lit(rows) - F.count(F.lit(1))).cast("bigint").alias("duplicate_rows"))
    else:
        # Counted while the rows are written, without a pass of its own.
        clean, gone = remove_duplicates(clean, order_key) if dedupe else (clean, 0)
        removed = local_rows(df.sparkSession, [(gone,)], duplicate_rows="bigint")
    dropped = local_rows(
        df.sparkSession,
        [(n, f"{100 * counts[n][1] / counts[n][0]:.1f}") for n in sparse],
        column="string",
        missing_pct="string",
    )
    clean = normalise_names(clean)
    encoded = encode(clean, encoding_plan(clean, [n for n in text_columns(clean) if n != order_key]))
    return Loaded(encoded.data, types, encoded.mapping, report_rows(dropped, removed))


def load(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    dedupe: bool = True,
    materialise: bool = True,
    **options,
) -> Loaded:
    """Read a CSV, XLSX, JSON or Parquet path and run the whole cleaning."""
    kind = format or source_format(path)
    df = read_table(spark, path, kind, **options)
    if kind == "json":
        df = json_types(df)
    return clean_and_encode(df, kind in ("csv", "xlsx"), dedupe, materialise)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first rows of a file that was read with a row-order key."""
    return df.orderBy(F.col(ROW_ORDER)).limit(n).drop(ROW_ORDER)
