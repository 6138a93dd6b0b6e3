"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of bytes other than space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def driver_table(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows of the driver as a frame.

    They travel as Arrow: of plain rows, ``createDataFrame`` makes a job that
    starts Python workers of its own on the executors, beside the operators'.
    """
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, as a task sees it, and the path in it."""
    local = re.fullmatch(r"file:/+(.*)", path)
    if local:
        return pafs.LocalFileSystem(), f"/{local[1]}"
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)
