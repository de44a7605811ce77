"""Parsers of whole files into segments, for use in Arrow functions."""

from __future__ import annotations

import ast
import io
import json
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa

SEGMENTS = pa.list_(pa.struct([("content", pa.string()), ("content_type", pa.string()), ("page_number", pa.int32()), ("metadata", pa.string())]))
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def segment(content: str, kind: str, page: int | None = None, **metadata) -> dict:
    return {"content": content, "content_type": kind, "page_number": page, "metadata": json.dumps(metadata, ensure_ascii=False) if metadata else None}


def text_of(data: bytes) -> str:
    for name in ("utf-8", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def markdown(rows: list[list[str | None]]) -> str:
    """A table as Markdown; blank rows go, short rows are filled up."""
    rows = [[(c or "").replace("\n", " ").strip() for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join(f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * width, *rows[1:]])


def python_units(source: str) -> list[dict]:
    """Top-level classes and functions as (symbol, start_line, end_line, content); none if the source has a syntax error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines, units = source.splitlines(), [n for n in tree.body if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
    return [{"symbol": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "content": "\n".join(lines[n.lineno - 1 : n.end_lineno])} for n in units]


def code(path: str, data: bytes) -> list[dict]:
    source = text_of(data)
    units = python_units(source) if path.lower().endswith(".py") else []
    return [segment(u.pop("content"), "code", **u) for u in units] or [segment(source, "code")]


def docx(path: str, data: bytes) -> list[dict]:
    """The paragraphs that aren't blank as one text segment, then each table."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    paragraphs = [said(p) for p in body.findall(f"{_WORD}p")]
    out = [segment("\n".join(p for p in paragraphs if p.strip()), "text")] if any(p.strip() for p in paragraphs) else []
    for t in body.findall(f"{_WORD}tbl"):
        rows = [["\n".join(said(p) for p in c.findall(f"{_WORD}p")) for c in r.findall(f"{_WORD}tc")] for r in t.findall(f"{_WORD}tr")]
        if made := markdown(rows):
            out.append(segment(made, "table"))
    return out


def ocr_pages(texts: list[str], least: int, most: int) -> list[int]:
    """Pages (from 1) to be read by OCR: those with less text than ``least`` characters, up to ``most`` of them (0: no bound)."""
    poor = [k for k, t in enumerate(texts, 1) if len((t or "").strip()) < least]
    return poor if most <= 0 else poor[:most]


def pages_to_segments(pages: list[tuple[str, list]], read_page: Callable[[int], str] | None = None, least: int = 80, most: int = 20) -> list[dict]:
    """Segments of pages (text, tables): of each page its text, its tables, and what ``read_page`` recognises on a page of little text. A page that can't be recognised has no such segment."""
    poor = set(ocr_pages([t for t, _ in pages], least, most)) if read_page else set()
    out = []
    for n, (t, tables) in enumerate(pages, 1):
        if (t or "").strip():
            out.append(segment(t, "text", n))
        out += [segment(m, "table", n) for rows in tables if (m := markdown(rows))]
        if n in poor:
            try:
                seen = "\n".join(dict.fromkeys(x for x in (y.strip() for y in read_page(n).splitlines()) if x))
            except Exception:  # one page's damage stays with it
                seen = ""
            if seen:
                out.append(segment(seen, "text", n))
    return out


def pdf(path: str, data: bytes, read_page: Callable[[int], str] | None = None) -> list[dict]:
    """Text and tables of each page, by a PDF library where one is installed; ``read_page`` is a recogniser of pages by number."""
    try:
        import pdfplumber
    except ImportError:
        return _pdf_text(data)
    with pdfplumber.open(io.BytesIO(data)) as doc:
        out = pages_to_segments([(page.extract_text() or "", page.extract_tables()) for page in doc.pages], read_page)
    return out or _pdf_text(data)


def _pdf_text(data: bytes) -> list[dict]:
    try:
        import pypdfium2
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    out = []
    for n, page in enumerate(pypdfium2.PdfDocument(data), 1):
        t = page.get_textpage().get_text_range().replace("\r\n", "\n")
        if t.strip():
            out.append(segment(t, "text", n))
    return out


PARSERS: dict[str, Callable[[str, bytes], list[dict]]] = {"code": code, "docx": docx, "pdf": pdf}


def parse(path: str, kind: str, data: bytes) -> tuple[list[dict] | None, str | None]:
    """The segments, or what went wrong."""
    try:
        return PARSERS[kind](path, data), None
    except Exception as e:  # any damage of one file stays in its row
        return None, f"{type(e).__name__}: {e}"
