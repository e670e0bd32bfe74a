"""Spreadsheets as units: a Markdown table per region of a sheet, in formats of the cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
MOST_BYTES, MOST_CELLS = 64 << 20, 1_000_000


def serial_date(serial: float) -> datetime:
    """Date of a serial number of the 1900 system, whose 29 February 1900 never was."""
    return datetime(1899, 12, 30) + timedelta(days=serial if serial >= 60 else serial + 1)


def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()
    return bool(re.search(r"[ymdhs]", bare)) and "general" not in bare


def shown(raw: str, code: str | None) -> str:
    """A number as its format shows it: dates, percentages, fixed decimals, thousands."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    if code and is_date(code):
        d = serial_date(x).replace(microsecond=0)
        return d.strftime("%Y-%m-%d") if x == int(x) else d.strftime("%Y-%m-%d %H:%M:%S")
    m = re.search(r"\.(0+)", code or "")
    decimals = len(m[1]) if m else 0
    if code and "%" in code:
        return f"{x * 100:.{decimals}f}%"
    if code and re.search("[0#]", code):
        return f"{x:,.{decimals}f}" if "," in code else f"{x:.{decimals}f}"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows) of every sheet with a cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError("the workbook is too large")
        names = set(z.namelist())
        xml = lambda p: ElementTree.fromstring(z.read(p))
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        codes: list[str | None] = []
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{MAIN}numFmt")}
            builtin = {9: "0%", 10: "0.00%", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00"} | dict.fromkeys(DATE_FORMATS, "yyyy-mm-dd")
            cells = styles.find(f"{MAIN}cellXfs")
            codes = [own.get(k, builtin.get(k)) for k in (int(x.get("numFmtId", 0)) for x in (cells if cells is not None else []))]
        targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        for sheet in xml("xl/workbook.xml").iter(f"{MAIN}sheet"):
            path = "xl/" + targets[sheet.get(REL)].removeprefix("/xl/")
            rows: list[list[str]] = []
            cells_read, number = 0, 0
            for row in xml(path).iter(f"{MAIN}row"):
                line: list[str] = []
                before, number = number, int(row.get("r", number + 1))
                if rows and number > before + 1:
                    rows.append([])  # rows that are not stored are blank
                for c in row.iter(f"{MAIN}c"):
                    cells_read += 1
                    if cells_read > MOST_CELLS:
                        raise ValueError("the sheet is too large")
                    v = c.find(f"{MAIN}v")
                    raw = v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    if c.get("t") == "s":
                        raw = shared[int(raw)]
                    elif c.get("t") == "b":
                        raw = "TRUE" if raw == "1" else "FALSE"
                    elif c.get("t") in (None, "n") and raw:
                        style = int(c.get("s", 0))
                        raw = shown(raw, codes[style] if style < len(codes) else None)
                    at = column_number(c.get("r")) if c.get("r") else len(line)
                    line += [""] * (at + 1 - len(line))
                    line[at] = raw
                rows.append(line)
            if any(x for r in rows for x in r):
                yield sheet.get("name"), rows


def markdown_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    cell = lambda x: x.replace("|", "\\|").replace("\n", "<br>")
    lines = ["| " + " | ".join(map(cell, r + [""] * (width - len(r)))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n"


def regions(rows: list[list[str]]) -> list[list[list[str]]]:
    """The rows between blank ones."""
    out: list[list[list[str]]] = [[]]
    for r in rows:
        if any(c.strip() for c in r):
            out[-1].append(r)
        elif out[-1]:
            out.append([])
    return [r for r in out if r]


def region_markdown(rows: list[list[str]]) -> str:
    """A region as text: lines of prose up to the first row with two filled cells, which heads a table of the rest without its empty columns."""
    filled = [[c.strip() for c in r if c.strip()] for r in rows]
    head = next((k for k, f in enumerate(filled) if len(f) > 1), len(rows))
    parts = [" ".join(f) for f in filled[:head]]
    table = rows[head:]
    if table:
        used = [k for k in range(max(map(len, table))) if any(k < len(r) and r[k].strip() for r in table)]
        parts.append(markdown_table([[r[k].strip() if k < len(r) else "" for k in used] for r in table]).rstrip("\n"))
    return "\n\n".join(parts)


def sheet_markdown(rows: list[list[str]]) -> str:
    """A sheet as its regions, one after the other."""
    return "\n\n".join(map(region_markdown, regions(rows))) + "\n"


def sheet_units(files: DataFrame) -> DataFrame:
    """path, unit_key and text of every sheet of the workbooks in ``files`` (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, f"sheet:{name.replace('#', '##')}", sheet_markdown(grid)) for p, data in zip(b["path"], b["content"], strict=True) for name, grid in read_sheets(data)]
            yield pd.DataFrame(rows, columns=["path", "unit_key", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, unit_key string, text string")
