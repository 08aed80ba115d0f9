"""Formats of files by name and content, text decoding and the two CSV readers."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions and media types of the formats, in order of precedence.
EXTENSIONS = {
    "PDF": ("pdf",), "DOCX": ("docx", "docm", "dotx", "dotm"), "XLSX": ("xlsx", "xlsm", "xltx", "xltm"), "PPTX": ("pptx", "pptm", "ppsx", "ppsm", "potx", "potm"), "ODT": ("odt", "ott"), "ODS": ("ods", "ots"), "ODP": ("odp", "otp"),
    "RTF": ("rtf",), "DOC": ("doc", "dot"), "XLS": ("xls", "xlt"), "PPT": ("ppt", "pps", "pot"), "EPUB": ("epub",), "HTML": ("html", "htm", "xhtml"), "CSV": ("csv",), "IMAGE": ("jpg", "jpeg", "png", "webp", "bmp", "gif", "heic", "heif"),
    "TXT": ("txt", "md", "log", "json", "xml", "ini", "kt", "java", "py", "js", "css", "yaml", "yml"),
}
MEDIA_TYPES = {
    "PDF": "application/pdf", "DOCX": "*wordprocessingml*", "XLSX": "*spreadsheetml*", "PPTX": "*presentationml*", "ODT": "*opendocument.text*", "ODS": "*opendocument.spreadsheet*", "ODP": "*opendocument.presentation*",
    "RTF": "application/rtf text/rtf", "DOC": "application/msword", "XLS": "application/vnd.ms-excel", "PPT": "application/vnd.ms-powerpoint", "EPUB": "application/epub+zip", "HTML": "text/html application/xhtml+xml",
    "CSV": "text/csv text/comma-separated-values", "IMAGE": "image/*", "TXT": "text/*",
}
SEPARATORS = (",", ";", "\t")


def _media(mime: Column, patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns.split():
        core = p.strip("*")
        out = out | (mime == core if core == p else mime.contains(core) if p.startswith("*") else mime.startswith(core))
    return F.coalesce(out, F.lit(False))


def by_extension(name: Column, mime: Column | None = None) -> Column:
    """A format by the extension or the media type; the first in order that either fits."""
    from leafmill.operators.catalog import extension

    ext = F.coalesce(extension(name), F.lit(""))
    out = None
    for fmt, known in EXTENSIONS.items():
        fits = ext.isin(*known) if mime is None else ext.isin(*known) | _media(mime, MEDIA_TYPES[fmt])
        out = F.when(fits, fmt) if out is None else out.when(fits, fmt)
    return out.otherwise("UNKNOWN")


def looks_text(b: bytes) -> bool:
    """S3: no NUL but after a UTF-16 mark, and fewer than one in fifty control bytes, in the first 4096."""
    head = b[:4096]
    if 0 in head:
        return head[:2] in (b"\xff\xfe", b"\xfe\xff")
    bad = sum(c < 9 or 14 <= c <= 31 for c in head)
    return bad * 50 < len(head) or not head


def decode_text(b: bytes) -> str:
    """By the byte order mark, else UTF-8 if it is valid, else windows-1251."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if b.startswith(mark):
            return b[len(mark) :].decode(name, "replace")
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        return b.decode("windows-1251", "replace")


def _directory(b: bytes) -> frozenset[str]:
    """Names of the parts of a package by its directory; of a damaged one by the heads of its parts."""
    try:
        return frozenset(zipfile.ZipFile(io.BytesIO(b)).namelist())
    except (zipfile.BadZipFile, NotImplementedError, UnicodeDecodeError, ValueError):
        return frozenset(name.decode("utf-8", "replace") for size, name in ((int.from_bytes(b[m.start() + 26 : m.start() + 28], "little"), b[m.start() + 30 :]) for m in re.finditer(rb"PK\x03\x04", b)) for name in [name[:size]])


def detect(b: bytes, by_name: str) -> str:
    """By content; the format of the name decides only where the content leaves it open."""
    if b"%PDF-" in b[:1024]:
        return "PDF"
    if b[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        head = b[:200]
        for mark, fmt in ((b"application/epub+zip", "EPUB"), (b"opendocument.text", "ODT"), (b"opendocument.spreadsheet", "ODS"), (b"opendocument.presentation", "ODP")):
            if mark in head:
                return fmt
        parts = _directory(b)
        for part, fmt in (("word/document.xml", "DOCX"), ("word/document2.xml", "DOCX"), ("xl/workbook.xml", "XLSX"), ("ppt/presentation.xml", "PPTX")):
            if part in parts:
                return fmt
        if "content.xml" in parts and by_name in ("ODT", "ODS", "ODP"):
            return by_name
        return by_name if by_name in ("DOCX", "XLSX", "PPTX", "EPUB") else "UNKNOWN"
    from leafmill.sources.legacy import MAGIC, Compound

    if b[:8] == MAGIC:
        try:
            names = Compound(b).names()
        except ValueError:
            return "UNKNOWN"
        for stream, fmt in (("encryptedpackage", "ENCRYPTED"), ("worddocument", "DOC"), ("workbook", "XLS"), ("book", "XLS"), ("powerpoint document", "PPT")):
            if stream in names:
                return fmt
        return "UNKNOWN"
    if b"{\\rtf" in b[:13]:
        return "RTF"
    if b[:3] == b"\xff\xd8\xff" or b[:4] in (b"\x89PNG", b"GIF8") or (b[:2] == b"BM" and by_name == "IMAGE") or (b[:4] == b"RIFF" and b[8:12] == b"WEBP") or (b[4:8] == b"ftyp" and b[8:12] in (b"heic", b"mif1")):
        return "IMAGE"
    if looks_text(b):
        head = b[:2048].decode("utf-8", "replace").lower()
        if "<!doctype html" in head or "<html" in head:
            return "HTML"
        return by_name if by_name in ("CSV", "HTML") else "TXT"
    return by_name


@F.pandas_udf(T.StringType())
def detected(content: pd.Series, by_name: pd.Series) -> pd.Series:
    """S2 over ``binaryFile`` contents; null contents give the format of the name."""
    return pd.Series([n if b is None else detect(bytes(b), n) for b, n in zip(content, by_name)])


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """S4 over ``binaryFile`` contents."""
    return pd.Series([None if b is None else decode_text(bytes(b)) for b in content])


def separator(text: str) -> str:
    """The sign that stands most often in the first five lines; the first of equals."""
    head = text.splitlines()[:5]
    return max(SEPARATORS, key=lambda c: (sum(line.count(c) for line in head), -SEPARATORS.index(c)))


def parse_csv(text: str) -> list[list[str]]:
    """Quotes switch anywhere, double quotes within them stand for one, quoted line breaks stay."""
    sep = separator(text)
    rows: list[list[str]] = []
    row: list[str] = []
    # pieces between quotes: even ones are outside
    cell = ""
    quoted = False
    i, n = 0, len(text)
    while i < n:
        stop = i
        while stop < n and text[stop] != '"' and (quoted or text[stop] not in (sep, "\n", "\r")):
            stop += 1
        cell += text[i:stop]
        if stop == n:
            break
        c = text[stop]
        i = stop + 1
        if c == '"':
            if quoted and text[i : i + 1] == '"':
                cell += '"'
                i += 1
            else:
                quoted = not quoted
            continue
        row.append(cell)
        cell = ""
        if c != sep:
            rows.append(row)
            row = []
            if c == "\r" and text[i : i + 1] == "\n":
                i += 1
    if cell or row:
        rows.append([*row, cell])
    return rows


def view_csv(text: str, most: int = 10_000) -> list[list[str]]:
    """Line by line, so quoted line breaks end a row; empty lines are left out; the first 10,000 lines, as the view shows no more."""
    sep = separator(text)
    return [parse_csv_line(line, sep) for line in [x for x in text.splitlines() if x][:most]]


def parse_csv_line(line: str, sep: str) -> list[str]:
    out, cell, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                cell += '"'
                i += 1
            else:
                quoted = not quoted
        elif c == sep and not quoted:
            out.append(cell)
            cell = ""
        else:
            cell += c
        i += 1
    return [*out, cell]
