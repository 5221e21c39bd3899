"""Excel workbooks without a library: an ``.xlsx`` file is an archive of XML sheets."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from feederflow.sources.draft import SourceError

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """The place of a cell in its row, from 0: letters count in base 26."""
    at = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _value(cell: ET.Element, shared: list[str]) -> str:
    kind, v = cell.get("t"), cell.findtext(f"{_M}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_M}t"))
    if v is None:
        return ""
    if kind == "s":
        return shared[int(v)]
    return {"1": "true", "0": "false"}.get(v, v) if kind == "b" else v


def sheets_of(content: bytes) -> dict[str, list[dict[str, str]]]:
    """The rows of each sheet by its lower-cased headings; sheets are tables by their trimmed, lower-cased names. Blank rows go."""
    out: dict[str, list[dict[str, str]]] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "xl/workbook.xml" not in names:
            raise SourceError("no workbook in the archive")
        shared = ["".join(t.text or "" for t in s.iter(f"{_M}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
            part = target[sheet.get(_R)]
            rows = []
            for row in ET.fromstring(z.read(part.lstrip("/") if part.startswith("/") else f"xl/{part}")).iter(f"{_M}row"):
                cells = {}
                for k, c in enumerate(row):
                    cells[_column(c.get("r")) if c.get("r") else k] = _value(c, shared).strip()
                if any(cells.values()):
                    rows.append(cells)
            if rows:
                heads = {k: v.lower() for k, v in rows[0].items() if v}
                out[sheet.get("name").strip().lower()] = [{h: r.get(k, "") for k, h in heads.items()} for r in rows[1:]]
    return out
