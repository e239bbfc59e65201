"""Workbooks written by hand as XML, with the forms that other programs give them."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenframe.sources import workbook as W

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets: dict[str, str], strings: str | None = None, styles: str | None = None, about: str = "", kinds: dict[str, str] | None = None) -> bytes:
    out = io.BytesIO()
    rels, listed = [], []
    with zipfile.ZipFile(out, "w") as z:
        for n, (name, rows) in enumerate(sheets.items()):
            z.writestr(f"xl/worksheets/s{n}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>" if rows is not None else "<worksheet><sheetData><row>")
            rels.append(f'<Relationship Id="r{n}" Type="{DOC}/{(kinds or {}).get(name, "worksheet")}" Target="{"/xl/" if n % 2 else ""}worksheets/s{n}.xml"/>')
            listed.append(f'<sheet name="{name}" sheetId="{n + 7}" r:id="r{n}"/>')
        for kind, part, text in (("sharedStrings", "sharedStrings.xml", strings), ("styles", "styles.xml", styles)):
            if text:
                z.writestr(f"xl/{part}", text)
                rels.append(f'<Relationship Id="{kind}" Type="{DOC}/{kind}" Target="{part}"/>')
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{''.join(rels)}</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{DOC}">{about}<sheets>{"".join(listed)}</sheets></workbook>')
    return out.getvalue()


def files(spark, **content):
    return spark.createDataFrame([(k, v) for k, v in content.items()], "path string, content binary")


def read(spark, content: bytes, skip: int = 0):
    return [(r["row"], r["cells"]) for r in W.rows(W.sheets(files(spark, a=content)), skip).orderBy("position", "row").collect()]


def test_cells_of_every_kind(spark):
    strings = f"<sst {MAIN}><si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh sb='0' eb='1'><t>no</t></rPh></si><si/></sst>"
    styles = f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="&quot;day &quot;0.00[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    head = "".join(f'<c t="inlineStr"><is><t>{h}</t></is></c>' for h in "abcdefghijklm")
    row = (
        '<c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>2</v></c><c><v>3</v></c><c><v>3.50</v></c><c t="b"><v>1</v></c><c t="e"><v>#DIV/0!</v></c><c s="1"><v>37742</v></c><c s="2"><v>37742.75</v></c>'
        '<c s="1"><v>0.5</v></c><c s="3"><v>37742</v></c><c t="str"><f>A1</f><v>made</v></c><c><f>A1</f></c>'
    )
    want = dict(a="plain", b="rich text", c="", d="3", e="3.5", f="True", g=None, h="2003-05-01 00:00:00", i="2003-05-01 18:00:00", j="12:00:00", k="37742", l="made", m=None)
    assert read(spark, book({"x": f"<row>{head}</row><row>{row}</row>"}, strings, styles)) == [(2, want)]
    since = read(spark, book({"x": f"<row>{head}</row><row>{row}</row>"}, strings, styles, '<workbookPr date1904="1"/>'))
    assert since[0][1]["h"] == "2007-05-02 00:00:00"
    early = book({"x": '<row><c t="str"><v>a</v></c></row><row><c s="1"><v>1</v></c></row><row><c s="1"><v>61</v></c></row><row><c s="1"><v>9e9</v></c></row>'}, None, styles)
    assert [c["a"] for _, c in read(spark, early)] == ["1900-01-01 00:00:00", "1900-03-01 00:00:00", "9000000000"]


def test_places_headings_and_blank_rows(spark):
    cell = lambda at, v: f'<c r="{at}" t="str"><v>{v}</v></c>'
    rows = f'<row r="1">{cell("A1", "title")}</row><row r="3">{cell("A3", "n")}{cell("C3", "n")}{cell("AB3", "far")}</row><row r="5">{cell("C5", "x")}{cell("AB5", "y")}{cell("AC5", "beyond")}</row><row r="6">{cell("A6", "z")}</row><row r="9"/>'
    got = read(spark, book({"x": rows}), 2)
    assert [r for r, _ in got] == [4, 5, 6]
    assert set(got[0][1].values()) == {None}
    assert {k: v for k, v in got[1][1].items() if v} == {"n.1": "x", "far": "y"}
    assert got[2][1]["n"] == "z" and "Unnamed: 1" in got[2][1] and len(got[2][1]) == 28
    assert read(spark, book({"x": rows}), 1) == [] and read(spark, book({"x": ""})) == []


def test_long_sheets_come_whole(spark):
    n = 3 * W._ROWS + 5
    rows = '<row><c t="str"><v>k</v></c></row>' + "".join(f"<row><c><v>{k}</v></c></row>" for k in range(n))
    assert [int(c["k"]) for _, c in read(spark, book({"x": rows}))] == list(range(n))


def test_what_cannot_be_read_is_named(spark):
    good = '<row><c t="str"><v>k</v></c></row><row><c><v>1</v></c></row>'
    given = files(spark, good=book({"x": good, "chart": good, "y": good}, kinds={"chart": "chartsheet"}), cut=book({"x": good, "y": None}), text=b"no book", none=None, zip=zipped())
    found = W.sheets(given)
    assert [(r["path"], r["position"], r["sheet"]) for r in found.where("error is null").orderBy("path", "position").collect()] == [("cut", 0, "x"), ("cut", 1, "y"), ("good", 0, "x"), ("good", 1, "y")]
    got = W.rows(found)
    assert {(r["path"], r["sheet"]) for r in got.where("error is not null").collect()} == {("cut", "y"), ("text", None), ("none", None), ("zip", None)}
    assert got.where("error is null").count() == 3
    empty = W.rows(W.sheets(files(spark, a=b"").limit(0)))
    assert empty.count() == 0 and empty.columns == ["path", "position", "sheet", "row", "cells", "error"]


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
    return out.getvalue()


@pytest.mark.parametrize("paying", ["PAYANT", "PAYANTE"])
def test_approvals_from_stored_files(spark, tmp_path, paying):
    text = lambda *vs: "<row>" + "".join(f'<c t="str"><v>{v}</v></c>' for v in vs) + "</row>"
    above = "<row/>" * 4
    year = above + text("TITRE", "VISA", paying, "OTHER") + text("FILM A", "123", "canal", "x") + text("N/A", "124", "", "y")
    (tmp_path / "b.xlsx").write_bytes(book({"2001": year, "2003": year, "2004 bis": year, "2005": year}))
    (tmp_path / "bad.xlsx").write_bytes(b"?")
    (tmp_path / "b.txt").write_bytes(b"?")
    got, bad = W.approvals(W.stored(spark, str(tmp_path)).withColumn("sheet", F.lit("clash")))
    rows = got.orderBy("cnc_agrement_year", "row").select("cnc_agrement_year", "row", "original_name", "visa_number", "paying_broadcasters", "budget").collect()
    assert [tuple(r) for r in rows] == [(y, n, t, v, p, None) for y in ("2003", "2005") for n, t, v, p in ((6, "FILM A", "123", "canal"), (7, None, "124", None))]
    assert "OTHER" not in got.columns
    assert [r["path"].rpartition("/")[2] for r in bad.collect()] == ["bad.xlsx"]


def test_sheets_are_dealt_out_whatever_their_size(spark):
    """Packed sheets are few bytes: they must not be put together in few tasks, which parse them one after another."""
    files = spark.createDataFrame([("a.xlsx", bytearray(book({"2001": "<row/>"}))), ("b.xlsx", bytearray(b"?"))], "path string, content binary")
    assert W.rows(W.sheets(files)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
