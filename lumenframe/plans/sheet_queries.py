"""Queries of workbooks. The driver's tables hold none, so orders are written as approval workbooks first: a workbook per 4,000 order numbers, a sheet per year, an order a film."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.settle import settled
from lumenframe.plans import ingest as I
from lumenframe.plans.catalogue import _t, query
from lumenframe.sources import workbook as W

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_STYLES = f'<styleSheet xmlns="{_MAIN}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'


def _sheet(table: list[list], strings: dict[str, int]) -> str:
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, date):
            return f'<c s="1"><v>{(v - date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, str):
            return f'<c t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'
        return f"<c><v>{v!r}</v></c>"

    lines = "".join(f'<row r="{5 + n}">{"".join(map(cell, line))}</row>' for n, line in enumerate(table))
    return f'<worksheet xmlns="{_MAIN}"><sheetData><row r="1"><c t="inlineStr"><is><t>Films</t></is></c></row>{lines}</sheetData></worksheet>'


def _book(named: dict[str, list[list]]) -> bytes:
    strings: dict[str, int] = {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, table in enumerate(named.values()):
            z.writestr(f"xl/worksheets/sheet{n}.xml", _sheet(table, strings))
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{"".join(f"<si><t>{escape(s)}</t></si>" for s in strings)}</sst>')
        z.writestr("xl/styles.xml", _STYLES)
        parts = [f'<Relationship Id="r{n}" Type="{_DOC}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(len(named))]
        parts += [f'<Relationship Id="s" Type="{_DOC}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="t" Type="{_DOC}/styles" Target="/xl/styles.xml"/>']
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_REL}">{"".join(parts)}</Relationships>')
        listed = "".join(f'<sheet name="{escape(name)}" sheetId="{n + 1}" r:id="r{n}"/>' for n, name in enumerate(named))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{listed}</sheets></workbook>')
    return out.getvalue()


def _books(orders: DataFrame) -> DataFrame:
    """(path, content): orders as workbooks, stored once."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for block, part in batch.groupby("block", sort=True):
                if held and held[0]["block"].iloc[0] != block:
                    yield book(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield book(pd.concat(held))

    def book(part: pd.DataFrame) -> pd.DataFrame:
        named = {"Synthèse": [["TITRE", "VISA"], ["total", len(part)]], "avis 20": [["TITRE"], ["rien"]]}
        for year, of in part.groupby("year", sort=True):
            heads = ["TITRE", "VISA", "DEVIS", "PAYANT" if year % 2 else "PAYANTE", "EOF", "ASR"]
            named[str(year)] = [heads, *([f"FILM {k}", k, price, "canal netflix" if k % 3 == 0 else None, " x " if k % 2 == 0 else "NA", when] for k, price, when in zip(of["o_orderkey"].tolist(), of["price"].tolist(), of["day"].tolist(), strict=True))]
        return pd.DataFrame({"path": [f"agrements-{part['block'].iloc[0]}.xlsx"], "content": [_book(named)]})

    day = F.col("o_orderdate").cast("date")
    cells = orders.select(F.floor(F.col("o_orderkey") / 4000).alias("block"), "o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.year(day).alias("year"), day.alias("day"))
    n = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, it is kept, whatever the cells' size
    return settled(cells.repartitionByRange(n, "block").sortWithinPartitions("block", "o_orderkey").mapInPandas(written, "path string, content binary"))


@query(
    """SELECT o_orderkey::VARCHAR AS visa_number, 'Film ' || o_orderkey AS film, year(o_orderdate)::INT AS year, o_totalprice::DOUBLE AS budget, o_orderkey % 2 = 0 AS eof,
    strftime(o_orderdate::DATE, '%Y-%m-%d 00:00:00') AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'Canal+,Netflix' ELSE '' END AS paying FROM orders"""
)
def workbook_rows(spark: SparkSession, d: str) -> DataFrame:
    """The yearly sheets of approval workbooks, read sheet by sheet and cleaned: titles, flags, budgets, dates and broadcasters."""
    read, _ = W.approvals(_books(_t(spark, d, "orders")))
    return I.clean_sheets(read).select("visa_number", F.col("original_name").alias("film"), F.col("cnc_agrement_year").alias("year"), "budget", "eof", F.col("asr").alias("day"), F.array_join("paying", ",").alias("paying"))


@query(
    """WITH o AS (SELECT o_orderkey // 4000 AS block, year(o_orderdate) AS y FROM orders) SELECT y::VARCHAR AS sheet, count(DISTINCT block) AS books, count(*) AS n FROM o WHERE y::VARCHAR LIKE '%19%' GROUP BY 1"""
)
def workbook_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Sheets whose name holds a text, in how many workbooks each is, and its rows there; only these are parsed."""
    found = W.sheets(_books(_t(spark, d, "orders"))).where(F.contains("sheet", F.lit("19")))
    return W.rows(found, 4).groupBy("sheet").agg(F.count_distinct("path").alias("books"), F.count("*").alias("n"))
