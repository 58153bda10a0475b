"""Excel workbooks as a Spark data source, and CSV export.

``spark.dataSource.register(WorkbookSource)`` and then
``spark.read.format("workbook").option("sheet", name).load(folder_or_file)``: one row per sheet row, with ``file``,
``excel_row`` (2 is the first row after the header) and ``cells`` (header to text). Every file is one input partition,
so many workbooks are read in parallel. Files are opened by the task that reads them, which needs a path that
executors share; workbooks in an object store are read with ``read_workbooks``, which takes them from Spark's
``binaryFile`` source instead.
"""

from __future__ import annotations

import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "file string, excel_row int, cells map<string,string>"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        return [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]


def sheet_rows(content: bytes, sheet: str) -> Iterator[tuple[int, dict[str, str | None]]]:
    """(row number, header to cell) of a sheet, blank rows left out; missing sheets raise."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = {s.get("name"): s.get(f"{_REL}id") for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")}
        if sheet not in names:
            raise ValueError(f"no sheet named {sheet}")
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        header: list[str | None] = []
        for row in ET.fromstring(book.read("xl/" + targets[names[sheet]].lstrip("/").removeprefix("xl/"))).iter(f"{_NS}row"):
            values: dict[int, str] = {}
            for i, c in enumerate(row.iter(f"{_NS}c")):
                raw = c.findtext(f"{_NS}v")
                text = shared[int(raw)] if c.get("t") == "s" and raw is not None else "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else raw
                if text is not None:
                    values[_column(c.get("r")) if c.get("r") else i] = text
            if not header:
                header = [(values.get(i) or "").strip() or None for i in range(max(values, default=-1) + 1)]
            elif any(v.strip() for v in values.values()):
                yield int(row.get("r", 0)), {h: values.get(i) for i, h in enumerate(header) if h}


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str) -> None:
        self.path, self.sheet = path, sheet

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".xlsx")]
        return [_File(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for n, cells in sheet_rows(f.read(), self.sheet):
                yield os.path.basename(partition.path), n, cells


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["sheet"])


def read_workbooks(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """The same rows from any file system that Spark reads."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = list(sheet_rows(bytes(content), sheet))
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "excel_row": [n for n, _ in found], "cells": [c for _, c in found]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(rows, SCHEMA)


def missing_sheets(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """file, missing: of every workbook, the required sheets that it doesn't have; further sheets don't matter."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            missing = [[s for s in required if s not in set(sheet_names(bytes(c)))] for c in batch["content"]]
            yield pd.DataFrame({"file": [p.rsplit("/", 1)[-1] for p in batch["path"]], "missing": missing})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(look, "file string, missing array<string>")


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 files: header, quotes doubled, CRLF."""
    df.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)
