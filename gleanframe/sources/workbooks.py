"""First sheets of a folder of workbooks, one file per task row."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe.session import materialise

# the functions below travel to the workers whole, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(reference: str) -> int:
    """0-based column of a cell reference such as ``AB12``."""
    place = 0
    for letter in re.match("[A-Z]+", reference).group():
        place = place * 26 + ord(letter) - ord("A") + 1
    return place - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets")
    wanted = sheets[0].get(_REL)
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == wanted:
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("workbook without a sheet")


# fixed values: numbers of the built-in formats that show a date or a time
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
# fixed values: built-in formats that show a time span beyond a day
SPAN_FORMATS = {46}
_EPOCHS = (datetime(1899, 12, 30), datetime(1904, 1, 1))


def format_kind(code: str) -> str | None:
    """date or span for a number format with letters of dates or times, None for any other."""
    # texts, escaped characters, fillers and conditions say nothing; [h] counts hours beyond a day
    bare = re.sub(r'"[^"]*"|\\.|[_*].', "", code)
    if re.search(r"\[(h+|m+|s+)\]", bare, re.I):
        return "span"
    bare = re.sub(r"\[[^\]]*\]", "", bare).split(";")[0]
    return "date" if re.search(r"[ymdhs]", bare, re.I) and not re.search("general", bare, re.I) else None


def _styles(book: zipfile.ZipFile) -> list[str | None]:
    """For every cell style, what its number means: a date, a time span, or None."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): format_kind(f.get("formatCode") or "") for f in root.iter(f"{_NS}numFmt")}
    used = root.find(f"{_NS}cellXfs")
    numbers = [int(x.get("numFmtId") or 0) for x in used] if used is not None else []
    return [own[n] if n in own else "date" if n in DATE_FORMATS else "span" if n in SPAN_FORMATS else None for n in numbers]


def _starts_1904(book: zipfile.ZipFile) -> bool:
    settings = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}workbookPr")
    return settings is not None and settings.get("date1904") in ("1", "true")


def moment_text(serial: str, kind: str, from_1904: bool) -> str:
    """The text of a date cell: a day, a day and time, or a time; a span in hours.

    Days before March 1900 are one off in the file, which counts a 29 February 1900.  What is no
    number, or out of range, stays as it is.
    """
    try:
        days = float(serial)
        micros = round(days * 86_400_000) * 1000
        if kind == "span":
            minutes, seconds = divmod(abs(micros) // 1_000_000, 60)
            return f"{'-' if days < 0 else ''}{minutes // 60}:{minutes % 60:02d}:{seconds:02d}"
        if 0 <= days < 1:
            return str((_EPOCHS[0] + timedelta(microseconds=micros)).time())
        moved = timedelta(days=1) if not from_1904 and 1 <= days < 60 else timedelta()
        moment = _EPOCHS[from_1904] + timedelta(microseconds=micros) + moved
    except (ValueError, OverflowError):
        return serial
    return str(moment.date()) if moment.time() == time() else str(moment)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cell texts of the first sheet, row by row; numbers in a date format as dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        styles, from_1904 = _styles(book), _starts_1904(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != f"{_NS}row":
                    continue
                cells: list[str | None] = []
                for cell in node:
                    at = _place(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = cell.get("t"), cell.find(f"{_NS}v")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    elif value is not None:
                        text = value.text
                        if kind == "s":
                            text = shared[int(text)]
                        elif kind == "b":
                            text = "True" if text == "1" else "False"
                        elif kind == "d":
                            text = text.replace("T", " ").removesuffix(" 00:00:00")
                        elif kind in (None, "n") and text and cell.get("s"):
                            style = int(cell.get("s"))
                            meant = styles[style] if style < len(styles) else None
                            text = moment_text(text, meant, from_1904) if meant else text
                        cells[at] = text
                yield cells
                node.clear()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows below the header with the column names of their own file; a surplus cell has a name by position."""
    columns = ["path", "row", "cells", "names"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            pending, header = [], []
            for i, cells in enumerate(sheet_rows(content)):
                if i == 0:
                    header = [c or f"column_{j}" for j, c in enumerate(cells)]
                names = header + [f"column_{j}" for j in range(len(header), len(cells))]
                pending.append((path, i, cells if i else [], names))
                if len(pending) == 5000:
                    yield pd.DataFrame(pending, columns=columns)
                    pending = []
            if pending:
                yield pd.DataFrame(pending, columns=columns)


def read_workbooks(
    files: DataFrame, *, with_origin: bool = False, columns: list[str] | None = None,
) -> DataFrame:
    """First sheets of (path, content) rows as text columns, matched by the names in each header.

    A workbook is at most about a million rows, so a file per task is the unit of work;
    many files spread over the cluster.  Each is parsed once: the texts are written before the
    headers are known.  Cells in a date format come as ISO dates, times or both.  A column that a workbook lacks is null there.  Given
    ``columns`` are taken by position instead.
    """
    rows = files.mapInPandas(_read, "path string, row bigint, cells array<string>, names array<string>")
    origin = ["path", "row"] if with_origin else []
    if columns is not None:
        cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)]
        return rows.where("row > 0").select(*origin, *cells)
    rows = materialise(rows, "workbook-rows")
    # one row per distinct header, in the order of the first file with it
    headers = rows.groupBy("names").agg(F.min("path").alias("first")).orderBy("first", F.size("names")).collect()
    found = list(dict.fromkeys(n for r in headers for n in r["names"]))
    place = {n: F.array_position("names", n).cast("int") for n in found}
    return rows.where("row > 0").select(*origin, *[
        F.when(place[n] > 0, F.get("cells", place[n] - 1)).alias(n) for n in found
    ])


def scan_workbooks(
    spark: SparkSession, path: str, *, with_origin: bool = False, columns: list[str] | None = None,
) -> DataFrame:
    """All first sheets under a folder, see :func:`read_workbooks`."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path).select("path", "content")
    )
    return read_workbooks(files, with_origin=with_origin, columns=columns)
