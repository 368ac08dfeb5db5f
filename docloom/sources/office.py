"""Office files and listings: archives of XML read with the standard library, one row of elements for each part.

Files come from ``binaryFile``; a file that can't be read gives a row with an
error and nothing else, so that one bad file never stops a run.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import BOLD_TITLE_MAX

ELEMENTS = "doc_id string, pos int, element_type string, content string, level int, rows int, cols int, slide_number int, style string, bold boolean, error string"
SHEET_ROWS = "doc_id string, sheet_name string, row_index long, cells array<string>, error string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (n for n in node.iter() if _local(n.tag) == name)


def _value(node: ET.Element | None, name: str = "val") -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None) if node is not None else None


def _child(node: ET.Element, name: str) -> ET.Element | None:
    return next((n for n in node if _local(n.tag) == name), None)


def style_level(style: str) -> int:
    digits = re.search(r"\d+", style)
    return max(1, min(3, int(digits.group()))) if digits else 1


def _text(node: ET.Element) -> str:
    out = []
    for n in node.iter():
        kind = _local(n.tag)
        out.append(n.text or "" if kind == "t" else "\t" if kind == "tab" else "\n" if kind in ("br", "cr") else "")
    return "".join(out)


def docx_elements(data: bytes) -> list[dict]:
    """Elements of a document's body in order; a heading is what has a Heading style, a bold title a short paragraph of bold runs only."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(_all(ET.fromstring(z.read("word/document.xml")), "body"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in _all(ET.fromstring(z.read("word/styles.xml")), "style"):
                names[_value(s, "styleId")] = _value(_child(s, "name")) or ""
    out = []
    for node in body:
        if _local(node.tag) == "p":
            props = _child(node, "pPr")
            style_id = _value(_child(props, "pStyle")) if props is not None else None
            style = names.get(style_id, style_id or "Normal")
            runs = [r for r in _all(node, "r") if _text(r)]
            off = lambda r: (b := _child(p, "b") if (p := _child(r, "rPr")) is not None else None) is None or _value(b) in ("0", "false")  # noqa: E731, B023
            text, bold = _text(node), bool(runs) and not any(off(r) for r in runs)
            common = {"style": style[:1].upper() + style[1:], "bold": bold}
            if common["style"].startswith("Heading"):
                out.append({"element_type": "heading", "content": text.strip(), "level": style_level(style), **common})
            elif not text.strip():
                out.append({"element_type": "blank", "content": "", **common})
            elif bold and len(text) <= BOLD_TITLE_MAX:
                out.append({"element_type": "bold_title", "content": text.strip(), **common})
            else:
                out.append({"element_type": "paragraph", "content": text, **common})
        elif _local(node.tag) == "tbl":
            rows = []
            for tr in (n for n in node if _local(n.tag) == "tr"):
                cells = ["\n".join(_text(p) for p in _all(tc, "p")).strip() for tc in tr if _local(tc.tag) == "tc"]
                rows.append([c for k, c in enumerate(cells) if k == 0 or c != cells[k - 1]])
            out.append({"element_type": "table", "content": "\n".join(" | ".join(r) for r in rows), "rows": len(rows), "cols": max(map(len, rows), default=0)})
    return out


def pptx_elements(data: bytes) -> list[dict]:
    """One element for each slide: its title, its other paragraphs, its notes."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        number = lambda n: int(re.search(r"(\d+)\.xml$", n).group(1))
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        for k, name in enumerate(slides, 1):
            title, rest = [], []
            for shape in _all(ET.fromstring(z.read(name)), "sp"):
                is_title = any((_value(p, "type") or "") in ("title", "ctrTitle") for p in _all(shape, "ph"))
                texts = [t for t in (_text(p).strip() for p in _all(shape, "p")) if t]
                (title if is_title else rest).extend(texts)
            notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
            if notes in z.namelist():
                rest += [t for t in (_text(p).strip() for p in _all(ET.fromstring(z.read(notes)), "p")) if t]
            out.append({"element_type": "slide", "content": "\n".join(title + rest), "slide_number": k})
    return out


def xlsx_rows(data: bytes) -> list[dict]:
    """Rows of all sheets in the workbook's order, cached values as text, rows without any value left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(ET.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {_value(r, "Id"): _value(r, "Target") for r in _all(ET.fromstring(z.read("xl/_rels/workbook.xml.rels")), "Relationship")}
        for sheet in _all(ET.fromstring(z.read("xl/workbook.xml")), "sheet"):
            target = (targets[_value(sheet, "id")] or "").lstrip("/")
            n = 0
            for row in _all(ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")), "row"):
                cells: list[str | None] = []
                for c in (x for x in row if _local(x.tag) == "c"):
                    letters = re.match(r"[A-Z]+", _value(c, "r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters.group()))) - 1 if letters else len(cells)
                    cells += [None] * (at - len(cells))
                    kind, v = _value(c, "t"), _child(c, "v")
                    raw = v.text if v is not None else None
                    if kind == "inlineStr":
                        raw = "".join(t.text or "" for t in _all(c, "t"))
                    elif kind == "s" and raw is not None:
                        raw = shared[int(raw)]
                    elif kind == "b" and raw is not None:
                        raw = "True" if raw == "1" else "False"
                    cells.append(raw)
                if any(c is not None for c in cells):
                    out.append({"sheet_name": _value(sheet, "name"), "row_index": n, "cells": cells})
                    n += 1
    return out


def _rows(files: DataFrame, parse, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows = [{"pos": k, "level": 0, **r} for k, r in enumerate(parse(data.as_py()))]
                except Exception as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pydict({n: [path if n == "doc_id" else r.get(n) for r in rows] for n in names}, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    return files.select("path", "content").mapInArrow(run, schema)


def list_files(spark: SparkSession, root: str, pattern: str = "*", folders: dict[str, str] | None = None) -> DataFrame:
    """Files below ``root``: ``(path, content, content_hash, file_name, ext, folder, modified)``; a folder's label comes from a map of path segments."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.lit(None).cast("string")
    for segment, label in (folders or {}).items():
        folder = F.coalesce(folder, F.when(F.contains("path", F.lit(f"/{segment}/")), label))
    return files.select("path", "content", F.sha2("content", 256).alias("content_hash"), name.alias("file_name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("ext"), folder.alias("folder"), F.col("modificationTime").alias("modified"))


def read_docx(files: DataFrame) -> DataFrame:
    return _rows(files, docx_elements, ELEMENTS)


def read_pptx(files: DataFrame) -> DataFrame:
    return _rows(files, pptx_elements, ELEMENTS)


def read_xlsx(files: DataFrame) -> DataFrame:
    return _rows(files, xlsx_rows, SHEET_ROWS)


def nested_elements(rows: DataFrame) -> DataFrame:
    """``(doc_id, els)`` for the chunkers, from one row for each element."""
    e = F.struct("pos", F.struct(F.col("element_type").alias("type"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("level", F.lit(0)).alias("level")).alias("e"))
    return rows.where("element_type is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(e)).alias("es")).select("doc_id", F.transform("es", lambda x: x["e"]).alias("els"))
