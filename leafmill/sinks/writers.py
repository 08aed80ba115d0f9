"""Documents and worksheets out of DataFrames (K1 to K4, K11, K12): one file per document, written by the executors."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.operators.formula import index_to_letters
from leafmill.plans.staging import stage

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_NUMBER = re.compile(r"^-?\d{1,12}(\.\d+)?$")
FILES = "name string, content binary"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)  # no clock: the same input gives the same bytes
    return out.getvalue()


def _rels(entries: list[tuple[str, str, str]]) -> str:
    return f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_REL}/{kind}" Target="{target}"/>' for i, kind, target in entries) + "</Relationships>"


def _types(overrides: dict[str, str]) -> str:
    return (
        f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + "".join(f'<Override PartName="{name}" ContentType="{kind}"/>' for name, kind in overrides.items()) + "</Types>"
    )


def _clean(text: str) -> str:
    """Without the control characters that XML forbids."""
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)


def sheet_name(name: str | None, i: int) -> str:
    """K4: at most 31 characters, reserved signs replaced; the number where it is blank."""
    return re.sub(r"[\\/*?:\[\]]", "_", (name or "")[:31].strip() or str(i + 1))


def xlsx(sheets: list[tuple[str | None, list[list[str]]]]) -> bytes:
    """K3, K4: a workbook of named sheets; a cell is a number if it looks like one without blanks and with a point."""
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n = len(sheets)
    parts = {
        "[Content_Types].xml": _types({"/xl/workbook.xml": f"{kind}.sheet.main+xml", **{f"/xl/worksheets/sheet{i + 1}.xml": f"{kind}.worksheet+xml" for i in range(n)}}),
        "_rels/.rels": _rels([("rId1", "officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_SHEET}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(_clean(sheet_name(name, i)))} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (name, _) in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _rels([(f"rId{i + 1}", "worksheet", f"worksheets/sheet{i + 1}.xml") for i in range(n)]),
    }
    for i, (_, rows) in enumerate(sheets):
        body = []
        for r, row in enumerate(rows):
            cells = []
            for c, text in enumerate(row):
                if not text:
                    continue
                ref, number = f"{index_to_letters(c)}{r + 1}", text.replace(" ", "").replace(",", ".")
                cells.append(f'<c r="{ref}"><v>{number}</v></c>' if _NUMBER.match(number) else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_clean(text))}</t></is></c>')
            body.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{i + 1}.xml"] = f'{_HEAD}<worksheet xmlns="{_SHEET}"><sheetData>{"".join(body)}</sheetData></worksheet>'
    return _zip(parts)


def docx(blocks: list[dict]) -> bytes:
    """K2: a document of headings and paragraphs with bold, italic and alignment."""
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{36 - 6 * i}"/></w:rPr></w:style>' for i in (1, 2))
    align = {"CENTER": "center", "RIGHT": "right", "JUSTIFY": "both"}
    body = []
    for b in blocks:
        if b.get("type") == "IMAGE":
            continue
        props = {"HEADING1": '<w:pStyle w:val="Heading1"/>', "HEADING2": '<w:pStyle w:val="Heading2"/>'}.get(b.get("type"), "")
        if b.get("align") in align:
            props += f'<w:jc w:val="{align[b["align"]]}"/>'
        runs = []
        for s in b.get("spans") or []:
            style = ("<w:b/>" if s.get("bold") else "") + ("<w:i/>" if s.get("italic") else "")
            text = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(_clean(line))}</w:t>' for line in (s.get("text") or "").split("\n"))
            runs.append(f"<w:r>{f'<w:rPr>{style}</w:rPr>' if style else ''}{text}</w:r>")
        body.append(f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{''.join(runs)}</w:p>")
    return _zip({
        "[Content_Types].xml": _types({"/word/document.xml": f"{kind}.document.main+xml", "/word/styles.xml": f"{kind}.styles+xml"}), "_rels/.rels": _rels([("rId1", "officeDocument", "word/document.xml")]),
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_WORD}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>', "word/styles.xml": f'{_HEAD}<w:styles xmlns:w="{_WORD}">{styles}</w:styles>',
        "word/_rels/document.xml.rels": _rels([("rId1", "styles", "styles.xml")]),
    })


def _docx_of(key: str):
    def made(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["pos"], r["idx"]))
        return pa.table({"name": [f"{rows[0][key]}.docx"], "content": pa.array([docx(rows)], pa.binary())})

    return made


def _xlsx_of(table: pa.Table) -> pa.Table:
    sheets: dict[int, tuple[str | None, dict[tuple[int, int], str]]] = {}
    for r in table.to_pylist():
        sheets.setdefault(r["sheet"], (r["sheet_name"], {}))[1][r["row"], r["col"]] = r["raw"] or ""
    out = []
    for _, (name, cells) in sorted(sheets.items()):
        height, width = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
        out.append((name, [[cells.get((r, c), "") for c in range(width)] for r in range(height)]))
    return pa.table({"name": [f"{table.column('book')[0].as_py()}.xlsx"], "content": pa.array([xlsx(out)], pa.binary())})


def to_docx(blocks: DataFrame, key: str = "project") -> DataFrame:
    """(name, content) of one document per ``key`` out of blocks (key, pos, idx, type, align, spans)."""
    return blocks.select(key, "pos", "idx", "type", "align", "spans").groupBy(key).applyInArrow(_docx_of(key), FILES)


def to_xlsx(cells: DataFrame) -> DataFrame:
    """(name, content) of one workbook per ``book`` out of cells."""
    return cells.select("book", "sheet", "sheet_name", "row", "col", "raw").groupBy("book").applyInArrow(_xlsx_of, FILES)


def text_to_cells(pages: DataFrame) -> DataFrame:
    """Lines of pages (doc, pos, text) as rows, cells apart by two or more blanks or a tab."""
    lines = pages.select("doc", "pos", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("doc").orderBy("pos", "n")) - 1
    return lines.withColumn("row", at).select(F.col("doc").alias("book"), F.lit(0).alias("sheet"), F.lit(None).cast("string").alias("sheet_name"), "row", F.posexplode(F.split("line", r"\s{2,}|\t")).alias("col", "raw"))


def save(files: DataFrame, path: str) -> None:
    """Write (name, content) rows as a Parquet table of files (K7: Spark commits it atomically)."""
    files.write.mode("overwrite").parquet(path)


def digests(files: DataFrame) -> DataFrame:
    """K9: (name, digest) of (name, content); a null content has none."""
    return files.select("name", F.sha1("content").alias("digest"))


def save_verified(files: DataFrame, path: str, opened: DataFrame | None = None) -> DataFrame:
    """K9: ``files`` saved at ``path`` and read back: their digests. A table that does not read back as it was written is an error.

    ``opened`` (name, digest) are the digests of the files as they were opened: if one of them has changed at ``path`` since, nothing is
    written and the names are told. Names that are new, or no longer there, are no conflict.
    """
    spark = files.sparkSession
    if opened is not None:
        now = digests(spark.read.parquet(path)).withColumnRenamed("digest", "now")
        changed = [r["name"] for r in opened.join(now, "name").where("not digest <=> now").select("name").orderBy("name").limit(10).collect()]
        if changed:
            raise FileExistsError(f"changed since they were opened: {changed}")
    new = stage(files)
    save(new, path)
    found, wanted = digests(spark.read.schema(new.schema).parquet(path)), digests(new)
    if not wanted.exceptAll(found).isEmpty() or not found.exceptAll(wanted).isEmpty():
        raise OSError(f"{path} does not read back as it was written")
    return found
