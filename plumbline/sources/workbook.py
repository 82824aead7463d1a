"""Excel workbooks (.xlsx): one task decodes one workbook, rows come out as cell arrays.

The first sheet is read. A sheet holds at most 1,048,576 rows by its format, so a workbook
always fits one task; many workbooks are decoded side by side.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import named
from ..session import scratch_dir
from .typing import cast_text, infer_types, tokens_to_null, unique_names

MOMENT = "\x02"  # marks a date cell; no text of a workbook can hold this character
ROWS_SCHEMA = "path string, row int, cells array<string>"
# Number formats of the workbook format that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", ref)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _text(node: ElementTree.Element) -> str:
    """Plain or rich text: the <t> children, without phonetic runs."""
    parts = [node.find(f"{_MAIN}t"), *node.findall(f"{_MAIN}r/{_MAIN}t")]
    return "".join(p.text or "" for p in parts if p is not None)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for fmt in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.I):
            dates.add(int(fmt.get("numFmtId")))
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, xf in enumerate(cells if cells is not None else []) if int(xf.get("numFmtId", 0)) in dates}


def _first_sheet(book: zipfile.ZipFile) -> str:
    names = book.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            if rel.get("Id") == sheet.get(_REL):
                target = rel.get("Target")
                return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def _day_zero(book: zipfile.ZipFile) -> datetime:
    """Day 0 of the workbook's date system."""
    if "xl/workbook.xml" in book.namelist():
        for setting in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}workbookPr"):
            if setting.get("date1904") in ("1", "true"):
                return datetime(1904, 1, 1)
    return datetime(1899, 12, 30)


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cell texts) of the first sheet; a date is MOMENT and ISO text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates, start = _date_styles(book), _day_zero(book)
        number = 0
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for cell in row:
                    at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells[at] = _text(cell.find(f"{_MAIN}is"))
                    elif value is None or kind == "e":
                        continue
                    elif kind == "s":
                        cells[at] = shared[int(value)]
                    elif kind == "b":
                        cells[at] = "True" if value == "1" else "False"
                    elif kind == "n" and int(cell.get("s", 0)) in dates:
                        moment = start + timedelta(milliseconds=round(float(value) * 86_400_000))
                        cells[at] = MOMENT + moment.isoformat(sep=" ")
                    else:
                        cells[at] = value
                number = int(row.get("r", number + 1))
                yield number, cells
                row.clear()


def decode_workbooks(files: DataFrame) -> DataFrame:
    """(path, content) rows to (path, row, cells) rows, in bounded batches; rows without a value are left out.

    Grouped by path, so that Python is handed one workbook after another: ungrouped, a batch would hold the contents of all
    workbooks of a partition, 10,000 at most."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                for number, cells in sheet_rows(content):
                    if any(c is not None for c in cells):
                        rows.append((path, number, cells))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["path", "row", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return files.select("path", "content").groupBy("path").applyInPandas(decode, ROWS_SCHEMA)


def read_workbooks(files: DataFrame) -> DataFrame:
    """(path, content) rows to one table: the first row with a value is a workbook's header, and all
    must agree. Cells beyond the header make columns that are numbered as blank headers are.
    Types are inferred over all workbooks; a column of date cells only is a timestamp. Workbooks are decoded once,
    to a Parquet copy in the shared folder."""
    spark = files.sparkSession
    path = scratch_dir(spark, "workbooks")
    decode_workbooks(files).write.parquet(path)
    rows = spark.read.schema(ROWS_SCHEMA).parquet(path)
    firsts = rows.groupBy("path").agg(F.min("row").alias("first"))
    headers = rows.join(firsts, "path").where("row = first").select("cells").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError("the workbooks have no header row, or different ones")
    width = rows.agg(F.max(F.size("cells"))).first()[0]
    header = [c and c.removeprefix(MOMENT) for c in headers[0]["cells"]]
    names = unique_names(header + [None] * (width - len(header)))
    body = rows.join(firsts, "path").where("row > first").select(
        *[tokens_to_null(F.get("cells", F.lit(i))).alias(name) for i, name in enumerate(names)]
    )
    types = infer_types(body)
    marks = [(F.count_if(named(n).startswith(MOMENT)) == F.count(named(n))).alias(f"m{i}") for i, n in enumerate(names) if types[n] == "string"]
    dated = body.agg(*marks).first().asDict() if marks else {}
    plain = body.select(*[F.ltrim(named(n), F.lit(MOMENT)).alias(n) for n in names])
    typed = cast_text(plain, types)
    moments = {n: named(n).cast("timestamp_ntz") for i, n in enumerate(names) if dated.get(f"m{i}")}
    return typed.select(*[moments.get(n, named(n)).alias(n) for n in names])


def read_xlsx(spark: SparkSession, path: str, glob: str | None = "*.xlsx") -> DataFrame:
    """First sheets of all workbooks under `path` that match `glob`; they share one header row."""
    reader = spark.read.format("binaryFile")
    return read_workbooks((reader.option("pathGlobFilter", glob) if glob else reader).load(path))
