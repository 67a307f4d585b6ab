"""Spreadsheets in the Office Open XML format, read in parallel by file and written from a result, with nothing but zip and XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of cell texts) of each sheet, in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{_MAIN}row"):
                cells: list[str] = []
                for i, c in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    v = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is None or v.text is None:
                        text = ""
                    else:
                        text = shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = text
                rows.append(cells)
            yield sheet.get("name"), rows


def xlsx_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of all sheets of all workbooks under ``path``; the first row of a sheet names its columns, blank rows are skipped.

    ``columns`` are the headers to read; a sheet without one has it empty. Files are parsed one per row on the executors.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                out = []
                for _, rows in sheets(bytes(content)):
                    head = [h.strip() for h in rows[0]] if rows else []
                    for row in rows[1:]:
                        record = {h: v.strip() for h, v in zip(head, row, strict=False) if h}
                        if any(record.values()):
                            out.append([record.get(c, "") for c in columns])
                yield pd.DataFrame(out, columns=columns, dtype=str)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    return files.mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def workbook(columns: list[str], rows: Iterator[tuple], sheet: str = "Sheet1") -> bytes:
    """One sheet with a header and rows, every cell as text."""

    def line(n: int, cells: list) -> str:
        return f'<row r="{n}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in cells) + "</row>"

    body = line(1, columns) + "".join(line(i, list(r)) for i, r in enumerate(rows, 2))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns} xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet {ns}><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_workbook(rows: DataFrame, path: str, sheet: str = "Sheet1", most: int = 1_000_000) -> None:
    """A report as one workbook; a sheet holds about a million rows, so larger results are refused before any row moves."""
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows don't fit a sheet; write Parquet or CSV instead")
    with open(path, "wb") as f:
        f.write(workbook(rows.columns, rows.toLocalIterator(), sheet))
