"""Minimal workbooks (Office Open XML) on the standard library."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _name(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def read(path: str, sheet: str | None = None) -> list[list[str]]:
    """The cells of a sheet as strings; gaps are empty."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(f"{_REL}id")]) for s in book.iter(f"{_MAIN}sheet")]
        found = sheets[0][1] if sheet is None else dict(sheets).get(sheet)
        if found is None:
            raise KeyError(f"no sheet {sheet!r}")
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        target = found.lstrip("/")
        tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows = []
    for row in tree.iter(f"{_MAIN}row"):
        cells: list[str] = []
        for c in row.iter(f"{_MAIN}c"):
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            value = c.find(f"{_MAIN}v")
            kind = c.get("t")
            raw = "" if value is None else value.text or ""
            cells[at] = _text(c) if kind == "inlineStr" else shared[int(raw)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else raw
        rows.append(cells)
    return rows


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write(path: str, sheet: str, header: list[str], rows: Iterable) -> None:
    """Rows are streamed into the sheet one by one."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _MAIN.strip("{}"), _REL.strip("{}")
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            out.write(_row(1, header))
            for n, row in enumerate(rows, 2):
                out.write(_row(n, row))
            out.write(b"</sheetData></worksheet>")


def _row(n: int, values) -> bytes:
    return f'<row r="{n}">{"".join(_cell(f"{_name(i)}{n}", v) for i, v in enumerate(values))}</row>'.encode()
