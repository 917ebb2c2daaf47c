"""Office files, texts and markdown to blocks. Files are read by Spark's binaryFile source and parsed on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators.chunking import Block, LISTED, level_of, plain_blocks, squeeze
from moraine.session import map_rows
from moraine.sources.html import BLOCK_SCHEMA, block_rows

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Reads images and scanned pages: bytes to text. None: such files give no text.
Ocr = Callable[[bytes], str]


def decode(data: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _table_rows(lines: list[str], path: list[str], sheet: str | None = None) -> list[Block]:
    return [Block(f"{lines[0]}\n{x}", kind="table_row", heading=path[-1] if path else "", path=list(path), source="table", sheet=sheet) for x in lines[1:]]


def docx_blocks(data: bytes) -> list[Block]:
    """Paragraphs and tables in the order of the body; cells that are merged count once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    out: list[Block] = []
    path: list[str] = []
    text_of = lambda e: squeeze("".join("\t" if t.tag == f"{W}tab" else t.text or "" for t in e.iter() if t.tag in (f"{W}t", f"{W}tab")))
    for e in body if body is not None else []:
        if e.tag == f"{W}p" and (t := text_of(e)):
            style = e.find(f"{W}pPr/{W}pStyle")
            m = re.match(r"(?i)heading\s*(\d)", style.get(f"{W}val", "") if style is not None else "")
            if m:
                path = [*path[: int(m[1]) - 1], t]
                out.append(Block(t, kind="heading", level=int(m[1]), heading=t, path=list(path)))
            else:
                out.append(Block(t, kind="list_item" if LISTED.match(t) else "paragraph", heading=path[-1] if path else "", path=list(path)))
        elif e.tag == f"{W}tbl":
            lines = []
            for row in e.iter(f"{W}tr"):
                cells = [text_of(c) for c in row.findall(f"{W}tc")]
                cells = [c for i, c in enumerate(cells) if c and (i == 0 or c != cells[i - 1])]
                if cells:
                    lines.append(" | ".join(cells))
            out += _table_rows(lines, path) if len(lines) > 1 else [Block(x, kind="table_row", path=list(path), source="table") for x in lines]
    return out


def xlsx_blocks(data: bytes) -> list[Block]:
    """A block with the name of each sheet, its header row, and each row under the header."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out: list[Block] = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
        name, target = sheet.get("name", ""), targets.get(sheet.get(f"{R}id"), "")
        lines = []
        with z.open("xl/" + target.lstrip("/").removeprefix("xl/")) as f:
            for _, row in ElementTree.iterparse(f):  # rows are dropped as soon as they are read
                if row.tag != f"{S}row":
                    continue
                cells = []
                for c in row.findall(f"{S}c"):
                    v = c.find(f"{S}v")
                    raw = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{S}t"))
                    cells.append(squeeze(shared[int(raw)] if c.get("t") == "s" and raw else raw))
                row.clear()
                if any(cells):
                    lines.append(" | ".join(cells))
        if lines:
            path = [f"Sheet: {name}"]
            out += [Block(path[0], kind="sheet_header", heading=path[0], path=path, source="table", sheet=name), Block(lines[0], kind="sheet_header", heading=path[0], path=path, source="table", sheet=name), *_table_rows(lines, path, name)]
    return out


def markdown_blocks(text: str | None, *, page: int = 1, path: list[str] | None = None, source: str = "ocr") -> list[Block]:
    """Headings, rows of pipe tables under their header, list items, and paragraphs in one line."""
    path, out, para, table = list(path or []), [], [], []

    def add(t: str, kind: str, level: int | None = None) -> None:
        out.append(Block(t, page, kind, level, path[-1] if path else "", list(path), "table" if kind == "table_row" else source, None, len(out)))

    def flush() -> None:
        if para:
            add(" ".join(para), "paragraph")
            para.clear()
        if len(table) == 1:
            add(table[0], "table_row")
        for x in table[1:]:
            add(f"{table[0]}\n{x}", "table_row")
        table.clear()

    for line in (text or "").splitlines():
        t = line.strip()
        if m := re.match(r"(#{1,6})\s+(.*\S)", t):
            flush()
            path = [*path[: len(m[1]) - 1], m[2]]
            add(m[2], "heading", len(m[1]))
        elif t.startswith("|") and t.count("|") > 1:
            if para:
                flush()
            if not re.fullmatch(r"[|\s:-]+", t):
                table.append(" | ".join(c.strip() for c in t.strip("|").split("|")))
        elif not t:
            flush()
        elif re.match(r"([-*+]|\d+[.)])\s+", t):
            flush()
            add(t, "list_item")
        else:
            if table:
                flush()
            para.append(t)
    flush()
    return out


def file_blocks(name: str, data: bytes, ocr: Ocr | None = None) -> list[Block]:
    """The blocks of a file by its extension; ValueError for kinds that aren't known."""
    kind = name.rpartition(".")[2].lower()
    if kind == "docx":
        return docx_blocks(data)
    if kind == "xlsx":
        return xlsx_blocks(data)
    if kind == "txt":
        return plain_blocks(decode(data))
    if kind == "md":
        return markdown_blocks(decode(data))
    if kind in ("pdf", "jpg", "jpeg", "png"):
        return markdown_blocks(ocr(data)) if ocr else []
    raise ValueError(f"unsupported file type: {kind}")


def read_files(spark: SparkSession, path: str, *, ocr: Ocr | None = None) -> DataFrame:
    """Block rows of all files below path, with the path and an error where a file couldn't be read. source_id: a hash of the path."""
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = []
            for i, p, content in zip(part["source_id"], part["path"], part["content"]):
                try:
                    got += [(*r, p, None) for r in block_rows(i, file_blocks(p, bytes(content), ocr))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    got.append((i, None, None, None, None, None, None, None, None, None, p, str(e)[:200]))
            frame = pd.DataFrame(got, columns=[*names, "path", "error"])
            for c in ("block_order", "page_number", "heading_level"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("source_id"), "path", "content").mapInPandas(run, BLOCK_SCHEMA + ", path string, error string")


def read_markdown(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Block rows of texts in markdown."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), lambda i, t: block_rows(i, markdown_blocks(t)), BLOCK_SCHEMA)


__all__ = ["decode", "docx_blocks", "file_blocks", "level_of", "markdown_blocks", "read_files", "read_markdown", "xlsx_blocks"]
