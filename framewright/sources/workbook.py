"""XLSX scan: a folder of workbooks, one workbook per task record."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.fixed_values import NULL_TOKENS
from framewright.sources.delimited import header_names

# Number formats that show dates or times (numbers fixed by the file format).
BUILT_IN_DATE_FORMATS = set(range(14, 23)) | set(range(45, 48))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node, name: str) -> list:
    return [n for n in node if _local(n.tag) == name]


def _text(node) -> str:
    """Text of a string item without phonetic hints."""
    parts = []
    for child in node:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts.append(_text(child))
    return "".join(parts)


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _is_date_code(code: str) -> bool:
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search(r"[ymdhs]", plain, re.IGNORECASE))


def _part(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _first_sheet(archive: zipfile.ZipFile) -> str:
    book = _part(archive, "xl/workbook.xml")
    links = _part(archive, "xl/_rels/workbook.xml.rels")
    sheet = next(n for n in book.iter() if _local(n.tag) == "sheet")
    wanted = next(v for k, v in sheet.attrib.items() if _local(k) == "id" and "}" in k)
    target = next(n.get("Target") for n in links if n.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    styles = _part(archive, "xl/styles.xml")
    if styles is None:
        return set()
    dates = set(BUILT_IN_DATE_FORMATS)
    formats: list[int] = []
    for section in styles:
        if _local(section.tag) == "numFmts":
            for f in section:
                if _is_date_code(f.get("formatCode", "")):
                    dates.add(int(f.get("numFmtId")))
        elif _local(section.tag) == "cellXfs":
            formats = [int(x.get("numFmtId", 0)) for x in section]
    return {i for i, number in enumerate(formats) if number in dates}


def _serial_to_text(serial: float, epoch_1904: bool) -> str:
    start = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30)
    moment = start + dt.timedelta(milliseconds=round(serial * 86_400_000))
    return moment.strftime("%Y-%m-%d %H:%M:%S")


def _cell_text(cell, shared: list[str], date_styles: set[int], epoch_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = _children(cell, "is")
        return _text(inline[0]) if inline else None
    value = _children(cell, "v")
    if not value or value[0].text is None:
        return None
    raw = value[0].text
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "e":
        return None
    if kind == "n" and int(cell.get("s", 0)) in date_styles:
        return _serial_to_text(float(raw), epoch_1904)
    return raw


def _sheet_rows(content: bytes) -> Iterator[dict[int, str]]:
    """Rows of the first sheet as ``{column index: text}``, streamed."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings = _part(archive, "xl/sharedStrings.xml")
        shared = [] if strings is None else [_text(item) for item in strings]
        styles = _date_styles(archive)
        book = _part(archive, "xl/workbook.xml")
        epoch = any(
            _local(n.tag) == "workbookPr" and n.get("date1904") in ("1", "true") for n in book.iter()
        )
        with archive.open(_first_sheet(archive)) as sheet:
            next_number = 1
            blanks = 0
            for _, node in ElementTree.iterparse(sheet):
                if _local(node.tag) != "row":
                    continue
                number = int(node.get("r", next_number))
                blanks += number - next_number
                next_number = number + 1
                row = {}
                for position, cell in enumerate(_children(node, "c")):
                    reference = cell.get("r")
                    index = _column_index(reference) if reference else position
                    text = _cell_text(cell, shared, styles, epoch)
                    if text is not None:
                        row[index] = text
                node.clear()
                if not row:
                    blanks += 1
                    continue
                # Blank rows count only between filled ones.
                for _ in range(blanks):
                    yield {}
                blanks = 0
                yield row


ROWS_PER_BATCH = 5_000


def _header_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(name, place)`` of the first row of each workbook; the rest is not parsed."""
    for batch in batches:
        for content in batch["content"]:
            names = _header(next(_sheet_rows(content), {}))
            yield pd.DataFrame({"name": names, "place": range(len(names))})


def _row_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``cells`` of each data row as a map from header name to text."""
    for batch in batches:
        for content in batch["content"]:
            rows = _sheet_rows(content)
            names = _header(next(rows, {}))
            out: list[dict] = []
            for row in rows:
                out.append({n: row[i] for i, n in enumerate(names) if i in row})
                if len(out) >= ROWS_PER_BATCH:
                    yield pd.DataFrame({"cells": out})
                    out = []
            if out:
                yield pd.DataFrame({"cells": out})


def _header(row: dict[int, str]) -> list[str]:
    width = max(row, default=-1) + 1
    return header_names([row.get(i, "") for i in range(width)])


def parse_workbooks(files: DataFrame) -> DataFrame:
    """``(content)`` -> one text column per header name of any workbook.

    Workbooks are united by column name. The header names are the only thing
    collected; rows go straight from the parser to the projection, unshuffled.
    """
    content = files.select("content")
    headers = [
        r["name"]
        for r in content.mapInPandas(_header_batches, "name string, place int")
        .groupBy("name")
        .agg(F.min("place").alias("place"))
        .orderBy("place", "name")
        .collect()
    ]
    rows = content.mapInPandas(_row_batches, "cells map<string,string>")

    def cell(name: str) -> Column:
        return F.try_element_at("cells", F.lit(name))

    return rows.select(*[F.when(~cell(n).isin(NULL_TOKENS), cell(n)).alias(n) for n in headers])


def read_workbooks(spark: SparkSession, path) -> DataFrame:
    """First sheet of every workbook below a path, one workbook per record."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xlsx")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("content")
    )
    return parse_workbooks(files)
