"""Workbooks (.xlsx) of small reports: a table as one sheet, written and read by the driver, with the standard library alone.

A workbook is one file and a sheet has a bound of its own, so what goes through here is bounded: `write_workbook` counts first and raises beyond `MOST_ROWS`. Files go through the
session's file system, so any folder that Spark reaches will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

MOST_ROWS = 100_000
# fixed values: the namespaces of the format
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def column_name(i: int) -> str:
    """The letters of the i-th column, from 0."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _cell(value: object, at: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'


def workbook_bytes(header: list[str], rows: list[tuple], sheet: str = "Sheet1") -> bytes:
    """The file of a workbook with one sheet."""
    lines = [f'<row r="{i}">' + "".join(_cell(v, f"{column_name(j)}{i}") for j, v in enumerate(row)) + "</row>" for i, row in enumerate([tuple(header), *rows], 1)]
    part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{part}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOCUMENT}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOCUMENT}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, _XML + text)
    return out.getvalue()


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as texts, null where there is none; shared and inline texts, numbers, booleans and results of formulas."""
    tag = lambda name: f"{{{_MAIN}}}{name}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(tag("t"))) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))]
        first = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f".//{tag('sheet')}").get(f"{{{_DOCUMENT}}}id")
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == first)
        sheet = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    out = []
    for row in sheet.iter(tag("row")):
        cells: list[str | None] = []
        for c in row.iter(tag("c")):
            at = column_number(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            value, kind = c.find(tag("v")), c.get("t")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(tag("t")))
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if kind == "s" else ("true" if value.text == "1" else "false") if kind == "b" else value.text
        out.append(cells)
    return out


def write_workbook(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """Writes a report of at most `MOST_ROWS` rows as one file; lists are written as text."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a workbook takes {MOST_ROWS} rows; write a table instead")
    data = workbook_bytes(df.columns, [tuple(r) for r in rows], sheet)
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(data)
    finally:
        out.close()


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet with its first row as header, all columns texts; rows without any cell are left out."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    rows = [r for r in sheet_rows(data) if any(c is not None for c in r)]
    if not rows:
        return spark.createDataFrame([], "value string")
    header = [c or f"column {i + 1}" for i, c in enumerate(rows[0])]
    body = [tuple((r + [None] * len(header))[: len(header)]) for r in rows[1:]]
    return spark.createDataFrame(body, ", ".join(f"`{c}` string" for c in header))
