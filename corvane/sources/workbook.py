"""Workbooks (.xlsx, .xlsm): sheets as rows of cells, read in the tasks with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.profile_table import column_profile, duplicate_rows, table_warnings

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
ROWS = "path string, sheet string, sheet_no int, row_no int, cells array<string>"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, its number, row number, cells) of the rows that a workbook stores."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)):
            target = links[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            data = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for at, row in enumerate(data.iter(f"{{{_NS['m']}}}row")):
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    i = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (i + 1 - len(cells))
                    v = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        cells[i] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is not None and v.text is not None:
                        cells[i] = shared[int(v.text)] if c.get("t") == "s" else {"1": "true", "0": "false"}[v.text] if c.get("t") == "b" else v.text
                yield sheet.get("name"), number, at, cells


def read_sheet_rows(files: DataFrame) -> DataFrame:
    """Rows of all sheets of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = [(path, *x) for x in sheet_rows(content)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "sheet_no", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, ROWS)


def header_names(cells: list[str | None]) -> list[str]:
    """Names of a header row: blanks by position, repeats numbered."""
    names: list[str] = []
    for i, c in enumerate(cells):
        name = (c or "").strip() or f"col_{i}"
        n = sum(1 for x in names if x == name or re.fullmatch(re.escape(name) + r"_\d+", x))
        names.append(f"{name}_{n}" if name in names else name)
    return names


def sheet_table(rows: DataFrame, path: str, sheet: str) -> DataFrame | None:
    """The table of one sheet: its first row that is not blank is the header, blank rows go, short rows are padded and long ones cut; columns that are numbers throughout are doubles. None without two rows."""
    filled = rows.where((F.col("path") == path) & (F.col("sheet") == sheet) & F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    first = filled.orderBy("row_no").limit(2).collect()
    if len(first) < 2:
        return None
    names = header_names(first[0]["cells"])
    body = filled.where(F.col("row_no") > first[0]["row_no"]).select("row_no", *[F.get("cells", i).alias(n) for i, n in enumerate(names)])
    text = body.agg(*[F.coalesce(F.bool_or(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast("double").isNull()), F.lit(True)).alias(f"t{i}") for i, n in enumerate(names)]).first()
    return body.select("row_no", *[F.col(f"`{n}`") if text[f"t{i}"] else F.col(f"`{n}`").cast("double").alias(n) for i, n in enumerate(names)])


def workbook_tables(rows: DataFrame, path: str) -> tuple[dict[str, DataFrame], str | None]:
    """The tables of all sheets that hold one, and the name of the longest."""
    counts = rows.where(F.col("path") == path).groupBy("sheet", "sheet_no").agg(F.count(F.lit(1)).alias("n")).orderBy("sheet_no").collect()
    tables = {r["sheet"]: t for r in counts if (t := sheet_table(rows, path, r["sheet"])) is not None}
    longest = max(tables, key=lambda s: next(r["n"] for r in counts if r["sheet"] == s), default=None)
    return tables, longest


def workbook_warnings(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the warnings and risk flags of all sheets together, sorted and distinct."""
    each = [table_warnings(column_profile(t.drop("row_no")), duplicate_rows(t.drop("row_no")), sheet=True) for t in tables.values()]
    both = reduce(DataFrame.unionByName, each)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return both.agg(united("warnings"), united("risk_flags"))


def workbook_sample(tables: dict[str, DataFrame], most: int = 300) -> DataFrame:
    """Rows of all sheets together with `_sheet`, at most so many, in the order of sheets and rows."""
    parts = [t.select(F.lit(i).alias("__sheet_no"), "row_no", F.lit(s).alias("_sheet"), *[F.col(f"`{c}`").cast("string").alias(c) for c in t.columns if c != "row_no"]) for i, (s, t) in enumerate(tables.items())]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return united.orderBy("__sheet_no", "row_no").limit(most).drop("__sheet_no", "row_no")
