"""Workbooks (zipped XML) as rows, read from frames of (path, content) as Spark's reader of binary files gives them.

A task that holds a workbook only copies its sheets out, packed, each with the texts that its cells point to; the sheets are dealt out and each is parsed as a stream, so that
a workbook of many sheets is read by many tasks and nothing passes the driver. Memory is that of a packed workbook, or of one workbook's shared texts.

* Cells are text: whole numbers without a fraction, truth as True and False, dates as 2003-05-01 00:00:00, times as 12:30:00. Errors, empty cells and formulas without a stored value are null.
* Null content, content that is no workbook and sheets that break off give a row with `error`; of a broken sheet the rows before the break stay.
* Blank rows between others are rows of nulls; blank rows at the end do not exist. A sheet without its heading row has no rows.
* Columns without a heading are named `Unnamed: 3`, repeated headings `NAME.1`; a cell beyond the heading row's last is left out.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import shutil
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import accumulate
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.fixed import SHEET_COLUMNS

#: Number formats that stand for dates and times, and texts that mean a missing value.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_SHEET = "path string, position int, sheet string, body binary, strings binary, styles binary, since_1904 boolean, error string"
_ROW = "path string, position int, sheet string, row long, cells map<string, string>, error string"
_ROWS = 2048
_BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, EOFError, OSError, NotImplementedError, RuntimeError)


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _packed(archive: zipfile.ZipFile, part: str) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as packed, archive.open(part) as source:
        shutil.copyfileobj(source, packed)
    return out.getvalue()


def _sheets(content: bytes) -> Iterator[tuple]:
    """(position, name, body, strings, styles, whether dates count from 1904) of each sheet of cells; charts are no sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        held = set(archive.namelist())
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        targets = {}
        for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")):
            targets[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join("/xl", r.get("Target", ""))).lstrip("/"))
        shared = {kind: _packed(archive, part) for kind, part in targets.values() if kind in ("sharedStrings", "styles") and part in held}
        about = book.find("{*}workbookPr")
        since = about is not None and about.get("date1904") in ("1", "true")
        position = 0
        for e in book.iterfind("{*}sheets/{*}sheet"):
            kind, part = targets[next(v for k, v in e.attrib.items() if _name(k) == "id" and k != "id")]
            if kind == "worksheet":
                yield position, e.get("name"), _packed(archive, part), shared.get("sharedStrings"), shared.get("styles"), since
                position += 1


def _elements(packed: bytes, name: str) -> Iterator[ElementTree.Element]:
    """The elements of a name, one at a time; each is emptied, with its parent, when the next is taken."""
    above: list[ElementTree.Element] = []
    wanted: dict[str, bool] = {}
    for event, e in ElementTree.iterparse(gzip.GzipFile(fileobj=io.BytesIO(packed)), events=("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if (found := wanted.get(e.tag)) is None:
            found = wanted[e.tag] = _name(e.tag) == name
        if found:
            yield e
            if above:
                above[-1].clear()


def _text(e: ElementTree.Element) -> str:
    """The runs of a text, without its phonetic guide."""
    return "".join(t.text or "" for part in e if _name(part.tag) in ("t", "r") for t in ([part] if _name(part.tag) == "t" else part.iterfind("{*}t")))


def _dated(packed: bytes | None) -> list[bool]:
    """By number of a cell's style, whether its numbers are dates or times."""
    if not packed:
        return []
    styles = ElementTree.fromstring(gzip.decompress(packed))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", f.get("formatCode", "").lower()) for f in styles.iterfind("{*}numFmts/{*}numFmt")}
    kinds = [int(x.get("numFmtId", 0)) for x in styles.iterfind("{*}cellXfs/{*}xf")]
    return [bool(re.search("[dmyhs]", own[k].replace("general", ""))) if k in own else k in DATE_FORMATS for k in kinds]


def _moment(days: float, since_1904: bool) -> str:
    if 0 <= days < 1:
        return f"{datetime(2000, 1, 1) + timedelta(seconds=round(days * 86400)):%H:%M:%S}"
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if days < 60 else 30)
    return str(start + timedelta(days=int(days), seconds=round(days % 1 * 86400)))


def _child(e: ElementTree.Element, name: str) -> ElementTree.Element | None:
    """The first child of that name in any namespace."""
    for c in e:
        if c.tag == name or c.tag.endswith(f"}}{name}"):
            return c
    return None


def _value(cell: ElementTree.Element, strings: list[str], dated: list[bool], since_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        held = _child(cell, "is")
        return None if held is None else _text(held)
    held = _child(cell, "v")
    text = held.text if held is not None else None
    if not text or kind == "e":
        return None
    if kind == "s":
        return strings[int(text)]
    if kind == "b":
        return str(text == "1")
    if kind != "n":
        return text
    number, style = float(text), int(cell.get("s", 0))
    if style < len(dated) and dated[style]:
        try:
            return _moment(number, since_1904)
        except OverflowError:
            pass
    return str(int(number)) if number.is_integer() else repr(number)


def _cells(packed: bytes, strings: list[str], dated: list[bool], since_1904: bool) -> Iterator[tuple[int, dict[int, str]]]:
    """(row's number from 1, column's number from 0 -> value) of each stored row; rows and cells without a place follow the one before."""
    at = 0
    for row in _elements(packed, "row"):
        at = int(row.get("r", at + 1))
        column, found = -1, {}
        for cell in row:
            if _name(cell.tag) != "c":
                continue
            column += 1
            if (place := cell.get("r")) and (letters := re.match("[A-Z]+", place)):
                column = 0
                for c in letters[0]:
                    column = column * 26 + ord(c) - 64
                column -= 1
            value = _value(cell, strings, dated, since_1904)
            if value is not None:
                found[column] = value
        yield at, found


def _named(heading: dict[int, str]) -> list[str]:
    """Names of a heading's columns, all different."""
    names: list[str] = []
    used: set[str] = set()
    for c in range(max(heading, default=-1) + 1):
        first = name = heading.get(c, f"Unnamed: {c}")
        n = 0
        while name in used:
            n += 1
            name = f"{first}.{n}"
        used.add(name)
        names.append(name)
    return names


def _rows(body: bytes, strings: bytes | None, styles: bytes | None, since_1904: bool, skip: int) -> Iterator[tuple[int, list[tuple[str, str | None]]]]:
    texts = [_text(e) for e in _elements(strings, "si")] if strings else []
    names: list[str] | None = None
    last = skip + 1
    for at, found in _cells(body, texts, _dated(styles), since_1904):
        if at == skip + 1:
            names = _named(found)
        elif at > skip + 1 and names and found:
            for blank in range(last + 1, at):
                yield blank, [(n, None) for n in names]
            yield at, [(n, found.get(c)) for c, n in enumerate(names)]
            last = at


def sheets(files: DataFrame) -> DataFrame:
    """A row (path, position, sheet, body, strings, styles, since_1904, error) per sheet of each workbook of (path, content), in the book's order from 0; `body` and what follows are packed parts for `rows`."""
    schema = files.sparkSession.createDataFrame([], _SHEET).schema
    arrow = pa.schema([("path", pa.string()), ("position", pa.int32()), ("sheet", pa.string()), ("body", pa.binary()), ("strings", pa.binary()), ("styles", pa.binary()), ("since_1904", pa.bool_()), ("error", pa.string())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda *row: pa.RecordBatch.from_pylist([dict(zip(arrow.names, row, strict=True))], schema=arrow)
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    for found in _sheets(content or b""):
                        yield one(path, *found, None)
                except (StopIteration, *_BROKEN) as e:
                    yield one(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")

    return files.select("path", "content").mapInArrow(dealt, schema)


def rows(found: DataFrame, skip: int = 0) -> DataFrame:
    """(path, position, sheet, row, cells, error) of the sheets of `sheets`, or of those kept of them. The row after the first `skip` is the heading; `row` is the number in the sheet, from 1; `cells` has every heading's name."""
    schema = found.sparkSession.createDataFrame([], _ROW).schema
    arrow = pa.schema([("path", pa.string()), ("position", pa.int32()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def listed(path: str, position: int, sheet: str, kept: list[tuple]) -> pa.RecordBatch:
        cells = [c for _, of in kept for c in of]
        ends = [0, *accumulate(len(of) for _, of in kept)]
        maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for k, _ in cells], pa.string()), pa.array([v for _, v in cells], pa.string()))
        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), len(kept))
        return pa.RecordBatch.from_arrays([same(path, pa.string()), same(position, pa.int32()), same(sheet, pa.string()), pa.array([r for r, _ in kept], pa.int64()), maps, pa.nulls(len(kept), pa.string())], schema=arrow)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, position, sheet, body, strings, styles, since, error = (c[i].as_py() for c in batch.columns)
                kept: list[tuple] = []
                try:
                    for row in _rows(body, strings, styles, since, skip) if error is None else ():
                        kept.append(row)
                        if len(kept) == _ROWS:
                            yield listed(path, position, sheet, kept)
                            kept = []
                except _BROKEN as e:
                    error = f"{type(e).__name__}: {e}"
                yield listed(path, position, sheet, kept)
                if error:
                    yield pa.RecordBatch.from_pylist([{"path": path, "position": position, "sheet": sheet, "row": None, "cells": None, "error": error}], schema=arrow)

    columns = [c.partition(" ")[0] for c in _SHEET.split(", ")]
    # packed sheets are few bytes and much work: a number given to repartition is kept, whatever their size
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.select(*columns).repartition(n, "path", "position").mapInArrow(parsed, schema)


def texts(cells: Column, name: str) -> Column:
    """The cell under a heading, null where the heading, the cell or a value in it is missing."""
    value = F.try_element_at(cells, F.lit(name))
    return F.when(~value.isin(MISSING), value)


def approvals(files: DataFrame, skip: int = 4) -> tuple[DataFrame, DataFrame]:
    """The yearly sheets of approval workbooks under each other, columns renamed as `ingest.sheets` takes them with `path`, `sheet` and `row`; and (path, sheet, error) of what could not be read.

    The first sheet is a summary and left out, as are sheets whose name is not of digits alone. A heading that no sheet has is a column of nulls; other headings are left out.
    """
    from lumenframe.operators.settle import settled

    listed = sheets(files).where("error is not null or (position > 0 and sheet rlike '^[0-9]+$')")
    read = settled(rows(listed, skip))
    cell = lambda name: texts(F.col("cells"), name)
    paying = F.when(F.map_contains_key("cells", F.lit("PAYANTE")), cell("PAYANTE")).otherwise(cell("PAYANT"))
    values = [(F.col("sheet") if name == "year" else paying if name == "PAYANTE" else cell(name)).alias(column) for name, column in SHEET_COLUMNS.items()]
    return read.where("error is null").select("path", "sheet", "row", *values), read.where("error is not null").select("path", "sheet", "error")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the workbooks of a folder, or of one."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
