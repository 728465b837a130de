"""Texts out of files: plain text, DOCX, EPUB, MOBI, PDF and DjVu text layers; what can't be read becomes a row that says why."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .html import html_to_markdown
from .mobi import read_mobi
from .pdf import read_pdf

MOST_UNPACKED, CHARS_PER_PAGE = 40 << 20, 2100
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARSED = StructType([StructField("markdown", StringType()), StructField("pages", IntegerType()), StructField("title", StringType()), StructField("authors", StringType()), StructField("year", IntegerType()), StructField("problem", StringType())])


def decode_text(raw: bytes) -> str:
    """UTF-8, with or without a mark, else Windows Latin, else UTF-8 with replacements."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def _unpack(archive: zipfile.ZipFile, name: str, left: list[int]) -> bytes:
    """A member of an archive; all members together stay under the limit."""
    with archive.open(name) as file:
        raw = file.read(left[0] + 1)
    if len(raw) > left[0]:
        raise ValueError("unpacks to too much")
    left[0] -= len(raw)
    return raw


def read_docx(raw: bytes) -> str:
    """Paragraphs, heading styles as #, table rows as cells between bars."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(_unpack(archive, "word/document.xml", [MOST_UNPACKED])).find(f"{_WORD}body")
    text = lambda x: "".join(t.text or "" for t in x.iter(f"{_WORD}t")).strip()
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_WORD}p":
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            m = re.fullmatch(r"(?:Heading|heading\s*)(\d)|(Title)", style.get(f"{_WORD}val", "") if style is not None else "")
            level = (int(m[1]) if m[1] else 1) if m else 0
            if line := text(node):
                out.append("#" * min(level, 6) + " " * bool(level) + line)
        elif node.tag == f"{_WORD}tbl":
            rows = [" | ".join(text(c) for c in row.iter(f"{_WORD}tc")) for row in node.iter(f"{_WORD}tr")]
            out.append("\n".join(r for r in rows if r.strip(" |")))
    return "\n\n".join(x for x in out if x)


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def read_epub(raw: bytes, page_limit: int = 0) -> dict:
    """Chapters in spine order, whole ones up to ``page_limit`` pages; title, authors and the earliest year of the package."""
    left = [MOST_UNPACKED]
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        container = ElementTree.fromstring(_unpack(archive, "META-INF/container.xml", left))
        package = next((n.get("full-path") for n in container.iter() if _local(n) == "rootfile"), None)
        if not package:
            raise ValueError("no package file")
        root = ElementTree.fromstring(_unpack(archive, package, left))
        items = {n.get("id"): n.get("href") for n in root.iter() if _local(n) == "item"}
        spine = [items.get(n.get("idref")) for n in root.iter() if _local(n) == "itemref"]
        parts, size, names = [], 0, set(archive.namelist())
        for href in spine:
            path = posixpath.normpath(posixpath.join(posixpath.dirname(package), (href or "").split("#")[0]))
            if href and path in names:
                chapter = html_to_markdown(decode_text(_unpack(archive, path, left)))
                if page_limit > 0 and parts and size + len(chapter) > page_limit * CHARS_PER_PAGE:
                    break
                if chapter:
                    parts.append(chapter)
                    size += len(chapter)
    said = lambda name: [n.text.strip() for n in root.iter() if _local(n) == name and n.text and n.text.strip()]
    years = [int(y) for date in said("date") for y in re.findall(r"\b(1[0-9]{3}|20[0-4][0-9])\b", date)]
    return {"markdown": "\n\n".join(parts), "title": next(iter(said("title")), None), "authors": ", ".join(said("creator")) or None, "year": min(years, default=None)}


def read_djvu(raw: bytes, page_limit: int = 0) -> tuple[str, int]:
    """Text layers of a DjVu file and its number of pages.

    Uncompressed layers are read; compressed ones are named as such.  A damaged layer is passed over.
    """
    pages, texts, packed = 0, [], False

    def walk(at: int, end: int) -> None:
        nonlocal pages, packed
        while at + 8 <= end:
            name, size = raw[at : at + 4], struct.unpack_from(">I", raw, at + 4)[0]
            start, stop = at + 8, min(at + 8 + size, end)
            if name == b"FORM":
                walk(start + 4, stop)
            elif name == b"INFO":
                pages += 1
            elif name == b"TXTa" and (page_limit <= 0 or pages <= page_limit):
                length = int.from_bytes(raw[start : start + 3], "big")
                text = raw[start + 3 : min(start + 3 + length, stop)].decode("utf-8", "replace").strip()
                texts.append(re.sub(r"[\x0B\x1D\x1F]", "\n", text))
            elif name == b"TXTz":
                packed = True
            at = stop + (size & 1)

    walk(4 if raw[:4] == b"AT&T" else 0, len(raw))
    if packed and not texts:
        raise ValueError("the text layer is compressed")
    return "\n\n".join(t for t in texts if t), pages


def parse(kind: str | None, raw: bytes | None, page_limit: int = 0) -> dict:
    """Markdown and metadata of one file, or the problem that keeps it from being read."""
    out = dict.fromkeys(PARSED.names)
    try:
        if kind in ("text", "markdown"):
            out["markdown"] = decode_text(raw)
        elif kind == "docx":
            out["markdown"] = read_docx(raw)
        elif kind == "epub":
            out |= read_epub(raw, page_limit)
        elif kind == "djvu":
            out["markdown"], out["pages"] = read_djvu(raw, page_limit)
        elif kind == "mobi":
            out |= read_mobi(raw)
        elif kind == "pdf":
            out |= read_pdf(raw, page_limit)
        else:
            out["problem"] = "no reader for this format is installed"
    except PermissionError as error:
        out["problem"] = str(error)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, TypeError, AttributeError, IndexError, OverflowError, RecursionError, struct.error, zlib.error) as error:
        out["problem"] = f"{type(error).__name__}: {error}"
    if out["markdown"] is not None and not out["pages"]:
        out["pages"] = max(1, round(len(out["markdown"]) / 1800))
    return out


def parse_documents(files: DataFrame, page_limit: int = 0) -> DataFrame:
    """Adds markdown, pages, title, authors, year and problem to files (kind, content)."""

    @F.pandas_udf(PARSED)
    def parsed(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = [parse(k, bytes(c) if c is not None else None, page_limit) for k, c in zip(kind, content, strict=True)]
        frame = pd.DataFrame(rows, columns=PARSED.names)
        return frame.astype({"pages": "Int32", "year": "Int32"})

    return files.withColumn("_p", parsed("kind", "content")).select(*files.columns, "_p.*")
