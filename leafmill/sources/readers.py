"""Files as DataFrames: ``binaryFile`` rows to cells or blocks, one file per row, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources import formats, legacy, office

CELLS = "book string, sheet int, sheet_name string, row int, col int, raw string, kind string, formula string, si int, num_fmt string, error string"
BLOCKS = "doc string, part int, idx int, type string, align string, spans array<struct<text:string,bold:boolean,italic:boolean>>, error string"
_SPANS = pa.list_(pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_())]))


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below ``path`` with format by content; hidden files and those in the making (.tmp) are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    listed = reader.load(path).withColumn("name", name).where(~F.col("name").startswith(".") & ~F.col("name").endswith(".tmp"))
    return listed.withColumn("fmt", formats.detected("content", formats.by_extension(F.col("name"))))


def _cells_of(data: bytes, fmt: str) -> list[dict]:
    if fmt == "XLSX":
        return office.xlsx_cells(data)
    if fmt == "XLS":
        return [dict(zip(("sheet", "sheet_name", "row", "col", "raw"), c)) for c in legacy.xls_cells(legacy.Compound(data))]
    if fmt == "ODS":
        return [dict(zip(("sheet", "sheet_name", "row", "col", "raw"), c)) for c in office.ods_cells(data)]
    if fmt == "CSV":
        return [{"sheet": 0, "sheet_name": "Sheet1", "row": r, "col": c, "raw": v} for r, row in enumerate(formats.parse_csv(formats.decode_text(data))) for c, v in enumerate(row)]
    raise ValueError(f"no sheet: {fmt}")


def _paragraphs(texts: list[str]) -> list[dict]:
    return [{"type": "PARAGRAPH", "spans": [{"text": t, "bold": False, "italic": False}], "align": "LEFT"} for t in texts]


def _slides(slides: list[tuple[str, list[str]]]) -> list[list[dict]]:
    return [[{"type": "HEADING1", "spans": [{"text": t, "bold": False, "italic": False}], "align": "LEFT"}, *_paragraphs(lines)] for t, lines in slides]


def _parts_of(data: bytes, fmt: str) -> list[list[dict]]:
    """Blocks of each part: slides and parts of a book, or the one text."""
    if fmt == "DOCX":
        return [office.docx_blocks(data)]
    if fmt == "ODT":
        return [office.odt_blocks(data)]
    if fmt == "DOC":
        return [_paragraphs(legacy.doc_paragraphs(legacy.Compound(data)))]
    if fmt == "RTF":
        return [_paragraphs(legacy.rtf_paragraphs(data))]
    if fmt == "PPTX":
        return _slides(office.pptx_slides(data))
    if fmt == "ODP":
        return _slides(office.odp_slides(data))
    if fmt == "PPT":
        return _slides(legacy.ppt_slides(legacy.Compound(data)))
    if fmt == "EPUB":
        return [office.html_blocks(part) for part in office.epub_parts(data)]
    if fmt == "HTML":
        return [office.html_blocks(office.foreign_html(data))]
    if fmt == "TXT":
        return [_paragraphs(formats.decode_text(data).splitlines())]
    raise ValueError(f"no text: {fmt}")


def _read(kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in (CELLS if kind == "cells" else BLOCKS).replace("array<struct<text:string,bold:boolean,italic:boolean>>", "x").split(", ")]
    types = (
        [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        if kind == "cells"
        else [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), _SPANS, pa.string()]
    )
    for batch in batches:
        for path, data, fmt in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), batch.column("fmt").to_pylist()):
            try:
                if kind == "cells":
                    rows = [(path, *(c.get(n) for n in names[1:])) for c in _cells_of(data or b"", fmt)]
                else:
                    rows = [(path, p, i, b["type"], b["align"], b["spans"], None) for p, part in enumerate(_parts_of(data or b"", fmt)) for i, b in enumerate(part)]
            except Exception as e:  # one broken file must not end the job
                rows = [(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"[:200])]
            for at in range(0, len(rows), 20_000):
                cols = list(zip(*rows[at : at + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _reader(kind: str):
    def run(batches):
        return _read(kind, batches)

    return run


def read_cells(found: DataFrame) -> DataFrame:
    """Cells of the sheets among ``files``; a file that cannot be read gives one row with ``error`` and no cell."""
    return found.where(F.col("fmt").isin("XLSX", "XLS", "ODS", "CSV")).select("path", "content", "fmt").mapInArrow(_reader("cells"), CELLS)


def read_blocks(found: DataFrame) -> DataFrame:
    """Blocks of the texts, slides and books among ``files``; a file that cannot be read gives one row with ``error`` and no block."""
    return found.where(F.col("fmt").isin("DOCX", "ODT", "DOC", "RTF", "PPTX", "ODP", "PPT", "EPUB", "HTML", "TXT")).select("path", "content", "fmt").mapInArrow(_reader("blocks"), BLOCKS)


WORDS = "block int, par int, line int, word int, text string, l int, t int, r int, b int, conf int, bold boolean, italic boolean"


def _hocr(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in WORDS.split(", ")]
    types = [*[pa.int32()] * 4, pa.string(), *[pa.int32()] * 5, pa.bool_(), pa.bool_(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        for page, text in zip(batch.column(key).to_pylist(), batch.column("hocr").to_pylist()):
            try:
                rows += [(page, *(w[n] for n in names), None) for w in office.hocr_words(text or "<div/>")]
            except Exception as e:  # one broken page must not end the job
                rows.append((page, *[None] * len(names), f"{type(e).__name__}: {e}"[:200]))
        cols = list(zip(*rows)) or [[]] * (len(names) + 2)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.schema.field(key).type, *types])], names=[key, *names, "error"])


def read_hocr(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Words of recognised pages (``key``, hocr); a page that cannot be read gives one row with ``error`` and no word."""
    return pages.select(key, "hocr").mapInArrow(partial(_hocr, key), f"{key} {pages.schema[key].dataType.simpleString()}, {WORDS}, error string")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per project, latest first; files that do not fit are left out."""
    schema = "id string, title string, createdAt bigint, updatedAt bigint, pages array<struct<id:string,ocrDone:boolean,confidence:int,revision:int>>, language string, detectedLanguage string"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED", multiLine=True, recursiveFileLookup=True, pathGlobFilter="project.json").where("id is not null").orderBy(F.col("updatedAt").desc(), "id")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recognised pages stored as JSON."""
    schema = "width int, height int, language string, confidence int, blocks array<struct<type:string,spans:array<struct<text:string,bold:boolean,italic:boolean>>,align:string,image:string,imageAspect:float>>, words array<struct<t:string,x:int,y:int,w:int,h:int,b:int,s:int>>"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED", multiLine=True, recursiveFileLookup=True)


def has_text(pages: DataFrame) -> DataFrame:
    """Documents with more than 80 letters on their first three pages (doc, pos, text)."""
    return pages.where("pos < 3").groupBy("doc").agg((F.sum(F.regexp_count("text", F.lit(r"\p{L}"))) > 80).alias("has_text"))
