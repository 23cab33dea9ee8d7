"""Excel workbooks (.xlsx) as DataFrames, read inside tasks in blocks of rows.

A workbook is a zip of XML parts. A task gets the bytes of one file, walks the rows of one sheet as they come out of the
archive, and puts out blocks of them; a sheet is whole nowhere, neither in a task nor on the driver, which only sees the
header. What a task holds is the file as it is on disk and its table of shared strings.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sheet that is read where a workbook has one of that name; else its first.
PREFERRED = "Master"
BLOCK_ROWS = 1000
ROWS = "file string, row_number long, cells array<string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(part: ElementTree.Element) -> str:
    """The text runs of a string item; phonetic hints are no part of it."""
    return "".join(x.text or "" for x in part.iter() if _local(x.tag) == "t" and x.get("phonetic") is None)


def _sheet_of(book: zipfile.ZipFile) -> str:
    """The archive's name of the sheet to read."""
    names = [(s.get("name"), next(v for k, v in s.attrib.items() if _local(k) == "id")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = parts[next((i for name, i in names if name == PREFERRED), names[0][1])]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, x in ElementTree.iterparse(part):
            if _local(x.tag) == "si":
                out.append(_texts(x))
                x.clear()
    return out


def _column(reference: str) -> int:
    """The column of a cell reference: A1 is 0, AB7 is 27."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _texts(cell)
    v = next((x.text or "" for x in cell if _local(x.tag) == "v"), "")
    return shared[int(v)] if kind == "s" and v else {"1": "TRUE", "0": "FALSE"}.get(v, "") if kind == "b" else v


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(row number, cells as text) of each row that has any, in order; dates are the serial numbers that the file has."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, at = _shared(book), 0
        with book.open(_sheet_of(book)) as part:
            for _, x in ElementTree.iterparse(part):
                if _local(x.tag) != "row":
                    continue
                at = int(x.get("r", at + 1))
                cells: list[str] = []
                for c in x:
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (k + 1 - len(cells))
                    cells[k] = _value(c, shared)
                if any(v.strip() for v in cells):
                    yield at, cells
                x.clear()


def _blocks(header: bool):
    """mapInArrow body over (path, content): the header of each file, or all that comes behind it."""

    def block(file: str, rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([n for n, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string()))], ["file", "row_number", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                rows, held = sheet_rows(content.as_py()), []
                first = next(rows, None)
                if header:
                    held = [first] if first else []
                    rows = iter(())
                for row in rows:
                    held.append(row)
                    if len(held) == BLOCK_ROWS:
                        yield block(file.as_py(), held)
                        held = []
                if held:
                    yield block(file.as_py(), held)

    return run


def read_xlsx(spark: SparkSession, path: str, row_number: str | None = None) -> DataFrame:
    """The rows of a workbook, or of several with one header, as text by the names of the first row; blank cells are empty.

    The sheet is the one named Master, else the first. Columns without a name are left out; of columns of one name the last
    counts. row_number names a column with the row of the sheet, where asked. A file may have 2 GB, as it is one value.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    headers = {tuple(r["cells"]) for r in files.mapInArrow(_blocks(True), ROWS).select("cells").distinct().limit(2).collect()}
    if len(headers) != 1:
        raise ValueError(f"no header, or several that differ, in {path}")
    names = {h.strip(): k for k, h in enumerate(headers.pop()) if h.strip()}
    values = [F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(h) for h, k in names.items()]
    return files.mapInArrow(_blocks(False), ROWS).select(*([F.col("row_number").alias(row_number)] if row_number else []), *values)
