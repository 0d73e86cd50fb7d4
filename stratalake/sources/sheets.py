"""Cells of spreadsheets (the zipped XML format) as JSON text, read with the standard library."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_DATE_IDS = {*range(14, 23), *range(45, 48)}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_sheet(content: bytes) -> dict:
    """{"tabs": {name: rows of cells}}; numbers as written, dates in ISO, empty cells null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        parse = lambda n: ElementTree.fromstring(z.read(n))
        texts = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dates = set()
        if "xl/styles.xml" in names:
            styles = parse("xl/styles.xml")
            own = {int(f.get("numFmtId")) for f in styles.iter() if _local(f.tag) == "numFmt" and re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
            for xfs in (x for x in styles if _local(x.tag) == "cellXfs"):
                dates = {i for i, x in enumerate(xfs) if int(x.get("numFmtId", 0)) in _DATE_IDS | own}
        links = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
        tabs = {}
        for s in (x for x in parse("xl/workbook.xml").iter() if _local(x.tag) == "sheet"):
            target = links[next(v for k, v in s.attrib.items() if _local(k) == "id")].lstrip("/")
            rows = []
            for row in (r for r in parse(target if target.startswith("xl/") else "xl/" + target).iter() if _local(r.tag) == "row"):
                cells: list = []
                for c in row:
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    value = next((x.text for x in c if _local(x.tag) == "v"), None)
                    kind = c.get("t")
                    if kind == "s" and value is not None:
                        value = texts[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    elif value is not None and kind in (None, "n") and int(c.get("s", 0)) in dates:
                        value = (datetime(1899, 12, 30) + timedelta(seconds=round(float(value) * 86400))).isoformat()
                    cells.append(value)
                rows.append(cells)
            tabs[s.get("name")] = rows
    return {"tabs": tabs}


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out, errors = [], []
        for content in pdf["content"]:
            try:
                out.append(json.dumps(read_sheet(bytes(content)), ensure_ascii=False))
                errors.append(None)
            except Exception as e:  # one broken file is a failed reading, not a failed job
                out.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:400])
        yield pd.DataFrame({"file_id": pdf["file_id"], "output_json": out, "error": errors})


def read_sheets(files: DataFrame) -> DataFrame:
    """(file_id, output_json, error) of files (file_id, content)."""
    return files.select("file_id", "content").mapInPandas(_read, "file_id string, output_json string, error string")
