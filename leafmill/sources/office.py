"""Packages of XML parts and marked-up text: worksheets, documents, slides, books, pages, recognised pages."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET


#: A package that unpacks to more is refused.
MAX_UNPACKED = 400_000_000
MAX_ROW, MAX_COL = 100_000, 2000
ODS_REPEAT, ODS_ROWS, ODS_COLS = 50, 10_000, 256


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attr(e: ET.Element, name: str) -> str | None:
    """An attribute by its local name."""
    for k, v in e.attrib.items():
        if local(k) == name:
            return v
    return None


class Package:
    """Parts of a zip file, read only when they are asked for, within a bound on their size."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if sum(i.file_size for i in self.zip.infolist()) > MAX_UNPACKED:
            raise ValueError("the package is too large")
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    def xml(self, name: str) -> ET.Element | None:
        data = self.read(name)
        return ET.fromstring(data) if data is not None else None

    def relations(self, part: str) -> dict[str, str]:
        """Ids and whole paths of the parts that ``part`` refers to."""
        folder, base = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
        out = {}
        for r in root if root is not None else ():
            if r.get("Id") and r.get("Target"):
                out[r.get("Id")] = resolve(folder, r.get("Target"))
        return out


def resolve(folder: str, target: str) -> str:
    """A path relative to a folder; one that begins with a slash is whole."""
    return posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))


def _texts(e: ET.Element, name: str = "t") -> str:
    return "".join(t.text or "" for t in e.iter() if local(t.tag) == name)


def all_text(e: ET.Element) -> str:
    """Text of an ODF subtree with its blanks, tabs and line breaks."""
    out = [e.text or ""]
    for c in e:
        name = local(c.tag)
        if name == "s":
            out.append(" " * int(attr(c, "c") or 1))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        elif name not in ("annotation", "tracked-changes"):
            out.append(all_text(c))
        out.append(c.tail or "")
    return "".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx_cells(data: bytes) -> list[dict]:
    """Cells, and a row with ``error`` for each sheet with cells beyond the bounds, with sheet, name, row, col, raw, kind, formula, group of a shared formula and number format."""
    p = Package(data)
    root = p.xml("xl/sharedStrings.xml")
    # phonetic readings (rPh) are no text of a cell
    strings = ["".join(t.text or "" for e in si if local(e.tag) != "rPh" for t in e.iter() if local(t.tag) == "t") for si in root] if root is not None else []
    formats: list[str | None] = []
    style = p.xml("xl/styles.xml")
    if style is not None:
        own = {e.get("numFmtId"): e.get("formatCode") for e in style.iter() if local(e.tag) == "numFmt"}
        for xfs in style:
            if local(xfs.tag) == "cellXfs":
                formats = [own.get(x.get("numFmtId"), x.get("numFmtId")) for x in xfs]
    book, rels = p.xml("xl/workbook.xml"), p.relations("xl/workbook.xml")
    sheets: list[tuple[str, str]] = []
    for s in book.iter() if book is not None else ():
        if local(s.tag) == "sheet":
            sheets.append((s.get("name") or str(len(sheets) + 1), rels.get(attr(s, "id") or "", f"xl/worksheets/sheet{len(sheets) + 1}.xml")))
    if not sheets:
        sheets = [(str(i + 1), n) for i, n in enumerate(sorted(n for n in p.names if n.startswith("xl/worksheets/sheet")))]
    out = []
    for k, (name, path) in enumerate(sheets):
        sheet = p.xml(path)
        row, beyond = -1, 0
        for r in (e for e in sheet.iter() if local(e.tag) == "row") if sheet is not None else ():
            row = int(r.get("r")) - 1 if (r.get("r") or "").isdigit() else row + 1
            col = -1
            for c in r:
                if local(c.tag) != "c":
                    continue
                col = _column(c.get("r")) if c.get("r") else col + 1
                if not (0 <= row <= MAX_ROW and 0 <= col <= MAX_COL):
                    beyond += 1
                    continue
                kind, value, formula, group = c.get("t"), "", None, None
                for e in c:
                    if local(e.tag) == "v":
                        value = e.text or ""
                    elif local(e.tag) == "is":
                        value = _texts(e)
                    elif local(e.tag) == "f":
                        formula, group = e.text, e.get("si") if e.get("t") == "shared" else None
                if kind == "s":
                    value = strings[int(value)] if value.isdigit() and int(value) < len(strings) else value
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                else:
                    try:
                        x = float(value)
                        value = str(int(x)) if x == int(x) and abs(x) < 1e15 else value
                    except (ValueError, OverflowError):
                        pass
                s = c.get("s")
                out.append({"sheet": k, "sheet_name": name, "row": row, "col": col, "raw": value, "kind": kind, "formula": formula, "si": int(group) if group is not None else None, "num_fmt": formats[int(s)] if s and int(s) < len(formats) else None})
        if beyond:
            out.append({"sheet": k, "sheet_name": name, "error": f"{beyond} cells beyond row {MAX_ROW} or column {MAX_COL}"})
    return out


def ods_cells(data: bytes) -> list[tuple[int, str, int, int, str]]:
    """Cells of an ODF sheet; repeated rows and columns count at most 50 times."""
    root = Package(data).xml("content.xml")
    out = []
    for k, table in enumerate(e for e in root.iter() if local(e.tag) == "table"):
        row = 0
        for r in (e for e in table.iter() if local(e.tag) == "table-row"):
            cells, col = [], 0
            for c in r:
                if local(c.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                text = "\n".join(all_text(p) for p in c if local(p.tag) == "p")
                for _ in range(min(int(attr(c, "number-columns-repeated") or 1), ODS_REPEAT)):
                    if text and col < ODS_COLS:
                        cells.append((col, text))
                    col += 1
            for _ in range(min(int(attr(r, "number-rows-repeated") or 1), ODS_REPEAT)):
                if row < ODS_ROWS:
                    out += [(k, attr(table, "name") or str(k + 1), row, c, t) for c, t in cells]
                row += 1
    return out


def _span(text: str, bold: bool = False, italic: bool = False) -> dict:
    return {"text": text, "bold": bold, "italic": italic}


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in spans:
        if not s["text"]:
            continue
        if out and (out[-1]["bold"], out[-1]["italic"]) == (s["bold"], s["italic"]):
            out[-1] = {**s, "text": out[-1]["text"] + s["text"]}
        else:
            out.append(s)
    return out


def _block(kind: str, spans: list[dict], align: str = "LEFT") -> dict:
    return {"type": kind, "spans": _merged(spans), "align": align}


_ALIGN = {"center": "CENTER", "right": "RIGHT", "end": "RIGHT", "both": "JUSTIFY", "justify": "JUSTIFY", "distribute": "JUSTIFY"}


def _on(e: ET.Element | None, name: str) -> bool:
    for c in e if e is not None else ():
        if local(c.tag) == name:
            return attr(c, "val") not in ("0", "false", "none", "off")
    return False


def _docx_paragraph(p: ET.Element, styles: dict[str, str]) -> dict:
    kind, align, spans = "PARAGRAPH", "LEFT", []
    for e in p:
        if local(e.tag) == "pPr":
            for c in e:
                if local(c.tag) == "pStyle":
                    name = styles.get(attr(c, "val") or "", attr(c, "val") or "").lower().replace(" ", "")
                    kind = "HEADING1" if name in ("heading1", "title", "заголовок1") else "HEADING2" if re.match(r"heading[2-9]|subtitle|заголовок[2-9]", name) else kind
                elif local(c.tag) == "jc":
                    align = _ALIGN.get(attr(c, "val") or "", "LEFT")
    for r in (e for e in p.iter() if local(e.tag) == "r"):
        props = next((c for c in r if local(c.tag) == "rPr"), None)
        text = ""
        for c in r:
            name = local(c.tag)
            text += c.text or "" if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "-" if name == "noBreakHyphen" else ""
        spans.append(_span(text, _on(props, "b"), _on(props, "i")))
    return _block(kind, spans, align)


def docx_blocks(data: bytes) -> list[dict]:
    """Paragraphs with headings by style name, bold, italic and alignment; a table row is one paragraph, its cells apart by `` | ``."""
    p = Package(data)
    body = p.xml("word/document.xml") or p.xml("word/document2.xml") if "word/document.xml" not in p.names else p.xml("word/document.xml")
    styles: dict[str, str] = {}
    sheet = p.xml("word/styles.xml")
    for s in sheet if sheet is not None else ():
        if local(s.tag) == "style":
            styles[attr(s, "styleId") or ""] = next((attr(c, "val") or "" for c in s if local(c.tag) == "name"), "")
    out: list[dict] = []

    def walk(e: ET.Element) -> None:
        for c in e:
            name = local(c.tag)
            if name == "p":
                out.append(_docx_paragraph(c, styles))
            elif name == "tbl":
                for row in (x for x in c if local(x.tag) == "tr"):
                    cells = [" ".join("".join(s["text"] for s in _docx_paragraph(q, styles)["spans"]) for q in x.iter() if local(q.tag) == "p").strip() for x in row if local(x.tag) == "tc"]
                    out.append(_block("PARAGRAPH", [_span("  |  ".join(cells))]))
            elif name in ("body", "sdt", "sdtContent", "ins", "smartTag", "customXml"):
                walk(c)

    walk(body)
    return out


def pptx_slides(data: bytes) -> list[tuple[str, list[str]]]:
    """Title and lines of each slide, by slide number."""
    p = Package(data)
    slides = sorted((int(m[1]), n) for n in p.names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for _, name in slides:
        title, lines = "", []
        for shape in (e for e in p.xml(name).iter() if local(e.tag) == "sp"):
            texts = [t for t in (_texts(q).strip() for q in shape.iter() if local(q.tag) == "p") if t]
            holder = next((attr(e, "type") for e in shape.iter() if local(e.tag) == "ph"), None)
            if holder in ("title", "ctrTitle") and not title:
                title = " ".join(texts)
            else:
                lines += texts
        out.append((title, lines))
    return out


def _odf_blocks(e: ET.Element, bold: dict[str, tuple[bool, bool]], out: list[dict]) -> None:
    for c in e:
        name = local(c.tag)
        if name in ("h", "p"):
            level = int(attr(c, "outline-level") or 1)
            spans: list[dict] = []

            def inline(x: ET.Element, style: tuple[bool, bool]) -> None:
                if x.text:
                    spans.append(_span(x.text, *style))
                for y in x:
                    n = local(y.tag)
                    if n == "s":
                        spans.append(_span(" " * int(attr(y, "c") or 1), *style))
                    elif n == "tab":
                        spans.append(_span("\t", *style))
                    elif n == "line-break":
                        spans.append(_span("\n", *style))
                    elif n != "annotation":
                        inline(y, bold.get(attr(y, "style-name") or "", style) if n == "span" else style)
                    if y.tail:
                        spans.append(_span(y.tail, *style))

            inline(c, (False, False))
            out.append(_block(("HEADING1" if level == 1 else "HEADING2") if name == "h" else "PARAGRAPH", spans))
        elif name == "table-row":
            cells = ["\n".join(all_text(p) for p in x.iter() if local(p.tag) == "p") for x in c if local(x.tag) == "table-cell"]
            out.append(_block("PARAGRAPH", [_span("  |  ".join(cells))]))
        elif name not in ("annotation", "tracked-changes", "sequence-decls"):
            _odf_blocks(c, bold, out)


def odt_blocks(data: bytes) -> list[dict]:
    """Headings, paragraphs, list items and table rows of an ODF text."""
    root = Package(data).xml("content.xml")
    bold = {}
    for s in (e for e in root.iter() if local(e.tag) == "style"):
        props = next((c for c in s if local(c.tag) == "text-properties"), None)
        if props is not None:
            bold[attr(s, "name") or ""] = (attr(props, "font-weight") in ("bold", "600", "700", "800", "900"), attr(props, "font-style") == "italic")
    out: list[dict] = []
    _odf_blocks(next(e for e in root.iter() if local(e.tag) == "text" and e.tag.endswith("}text")), bold, out)
    return out


def odp_slides(data: bytes) -> list[tuple[str, list[str]]]:
    """Title and lines of each page of an ODF presentation."""
    out = []
    for page in (e for e in Package(data).xml("content.xml").iter() if local(e.tag) == "page"):
        title, lines = "", []
        for frame in (e for e in page.iter() if local(e.tag) == "frame"):
            texts = [t for t in (all_text(p).strip() for p in frame.iter() if local(p.tag) == "p") if t]
            if attr(frame, "class") == "title" and not title:
                title = " ".join(texts)
            else:
                lines += texts
        out.append((title, lines))
    return out


def epub_parts(data: bytes) -> list[str]:
    """The body markup of the parts of a book in reading order."""
    p = Package(data)
    container = p.xml("META-INF/container.xml")
    opf = next(e.get("full-path") for e in container.iter() if local(e.tag) == "rootfile")
    root = p.xml(opf)
    manifest = {e.get("id"): e.get("href") for e in root.iter() if local(e.tag) == "item"}
    out = []
    for ref in (e.get("idref") for e in root.iter() if local(e.tag) == "itemref"):
        href = manifest.get(ref)
        part = p.read(resolve(posixpath.dirname(opf), re.sub("#.*", "", href))) if href else None
        if part is not None:
            from leafmill.sources.formats import decode_text

            html = decode_text(part)
            body = re.search(r"(?is)<body[^>]*>(.*)</body>", html)
            out.append(body[1] if body else html)
    return out


_BLOCK = re.compile(r"(?is)<(h[1-6]|p)\b([^>]*)>(.*?)</\1\s*>")
_LEAF = re.compile(r"(?is)<(td|th|li)\b([^>]*)>((?:(?!</?(?:p|td|th|li)\b).)*?)</\1\s*>")
_INLINE = re.compile(r"(?is)<(/?)([a-z0-9]+)([^>]*)>|([^<]+)")
_VOID = frozenset("img hr input meta col br".split())


def unescape(s: str) -> str:
    """numeric entities, then the named ones, ``&amp;`` last."""
    s = re.sub(r"&#(?:x([0-9a-fA-F]+)|(\d+));", lambda m: _char(int(m[1], 16) if m[1] else int(m[2])), s)
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        s = s.replace(name, sign)
    return s


def _char(n: int) -> str:
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else ""


def inline_spans(html: str) -> list[dict]:
    """text with bold and italic by tags and styles; neighbours of one style are merged."""
    spans: list[dict] = []
    bold = italic = False
    stack: list[tuple[bool, bool]] = []
    for m in _INLINE.finditer(html):
        closing, tag, attrs, text = m.groups()
        if text is not None:
            spans.append(_span(unescape(text), bold, italic))
            continue
        tag = tag.lower()
        if tag == "br":
            spans.append(_span("\n", bold, italic))
        elif tag in _VOID:
            continue
        elif closing:
            if stack:
                bold, italic = stack.pop()
        else:
            stack.append((bold, italic))
            bold = (bold or tag in ("b", "strong") or bool(re.search(r"font-weight:\s*(bold|[6-9]00)", attrs))) and "font-weight:normal" not in attrs
            italic = italic or tag in ("i", "em") or "font-style:italic" in attrs
    return _merged(spans)


def html_blocks(html: str) -> list[dict]:
    """headings and paragraphs of markup; cells and list items without paragraphs are paragraphs; empty paragraphs stay."""
    body = re.search(r"(?is)<body[^>]*>(.*)</body>", html)
    clean = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", body[1] if body else html)
    clean = _LEAF.sub(lambda m: f"<p{m[2]}>{m[3]}</p>", clean)
    out = []
    for tag, attrs, inner in _BLOCK.findall(clean):
        spans = inline_spans(inner)
        tag = tag.lower()
        if not any(s["text"].strip() for s in spans):
            if tag == "p":
                out.append(_block("PARAGRAPH", []))
            continue
        style = re.search(r'(?i)style\s*=\s*"([^"]*)"', attrs)
        style = style[1] if style else ""
        align = next((a.upper() for a in ("center", "right", "justify") if f"text-align:{a}" in style), "LEFT")
        if "font-weight:bold" in style or "font-weight:700" in style:
            spans = [{**s, "bold": True} for s in spans]
        out.append(_block("HEADING1" if tag == "h1" else "HEADING2" if tag in ("h2", "h3") else "PARAGRAPH", spans, align))
    return out


def foreign_html(data: bytes) -> str:
    """Markup by the character set that its first 2048 bytes name."""
    m = re.search(rb"charset\s*=\s*[\"']?([\w-]+)", data[:2048], re.IGNORECASE)
    if m:
        try:
            return data.decode(m[1].decode("ascii"))
        except (LookupError, UnicodeDecodeError):
            pass
    from leafmill.sources.formats import decode_text

    return decode_text(data)


_HOCR = ("ocr_carea", "ocr_par", ("ocr_line", "ocr_header", "ocr_caption", "ocr_textfloat"), ("ocrx_word", "ocr_word"))


def hocr_words(hocr: str) -> list[dict]:
    """Words of a recognised page with block, par, line, word, box, confidence; missing parents are made up, words without text left out."""
    text = re.sub(r"<!DOCTYPE[^>]*>", "", hocr)
    text = re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)", "&amp;", text)
    out: list[dict] = []
    at = [-1, -1, -1, -1]

    def title(e: ET.Element, name: str) -> list[str]:
        for part in (e.get("title") or "").split(";"):
            words = part.split()
            if words and words[0] == name:
                return words[1:]
        return []

    def walk(e: ET.Element) -> None:
        kind = (e.get("class") or "").split(" ")[0]
        depth = next((i for i, k in enumerate(_HOCR) if kind == k or (isinstance(k, tuple) and kind in k)), None)
        if depth is not None:
            for parent in range(depth):
                at[parent] = max(at[parent], 0)
            at[depth] += 1
            at[depth + 1 :] = [-1] * (3 - depth)
        if depth == 3:
            content = "".join(e.itertext()).strip()
            box = [int(float(v)) for v in title(e, "bbox")] or [0, 0, 0, 0]
            if content:
                tags = {local(x.tag).lower() for x in e.iter()}
                conf = title(e, "x_wconf")
                out.append({"block": at[0], "par": at[1], "line": at[2], "word": at[3], "text": content, "l": box[0], "t": box[1], "r": box[2], "b": box[3], "conf": int(float(conf[0])) if conf else -1, "bold": bool(tags & {"b", "strong"}), "italic": bool(tags & {"i", "em"})})
            else:
                at[3] -= 1
            return
        for c in e:
            walk(c)

    walk(ET.fromstring(text))
    return out


