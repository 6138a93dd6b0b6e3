"""Reader chosen by file suffix, and conversion to CSV."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from framewright.functions.columns import nan_to_null
from framewright.sources.delimited import read_csv, write_csv
from framewright.sources.records import read_json
from framewright.sources.workbook import read_workbooks

FORMATS = {
    ".csv": "csv",
    ".xlsx": "xlsx",
    ".json": "json",
    ".jsonl": "json",
    ".parquet": "parquet",
}


def source_format(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError("Unsupported file format. Use CSV, XLSX, JSON or Parquet.")
    return FORMATS[suffix]


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Untyped columns of text formats stay text; Parquet keeps its types."""
    kind = format or source_format(path)
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "json":
        return read_json(spark, path, **options)
    if kind == "xlsx":
        return read_workbooks(spark, path, **options)
    if kind == "parquet":
        return nan_to_null(spark.read.parquet(path))
    raise ValueError(f"Unsupported file format: {kind}")


def convert_to_csv(df: DataFrame, path: str) -> str:
    """CSV copy of a frame read from a workbook or JSON."""
    write_csv(df, path)
    return path
