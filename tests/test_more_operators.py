from pyspark.sql import functions as F

from leafmill.functions import numbers as N
from leafmill.functions import text as X
from leafmill.operators import catalog as C
from leafmill.operators import sheet as Q

PAGES = "pages array<struct<id:string,rotation:int>>"


def pages(spark, ids):
    return spark.createDataFrame([([(i, 0) for i in ids],)], PAGES)


def ids(df, column):
    return "".join(p.id for p in df.select(column.alias("p")).first().p)


def test_page_selection(spark):
    df = pages(spark, "abcde")
    p = F.col("pages")
    assert ids(df, C.shift_selected(p, ["c", "d"])) == "acdbe" and ids(df, C.shift_selected(p, ["a", "b"])) == "abcde" and ids(df, C.shift_selected(p, ["c", "d"], True)) == "abecd" and ids(df, C.shift_selected(p, ["a", "c"])) == "acbde"
    assert ids(df, C.keep(p, ["e", "a"])) == "ae" and ids(df, C.drop(p, list("abcde"))) == "abcde" and ids(df, C.drop(p, ["a"])) == "bcde"
    assert [x.rotation for x in df.select(C.rotate(p, ["b"], -90).alias("p")).first().p] == [0, 270, 0, 0, 0]


def test_folders_and_names(spark):
    log = spark.createDataFrame([("a", "A", 1, False), ("b", "B", 2, False), ("a", "A2", 3, False), ("c", "C", 4, False), ("c", "C", 5, True)], "uri string, name string, time int, removed boolean")
    assert [(r.uri, r.name) for r in C.folders(log).collect()] == [("b", "B"), ("a", "A2")]
    df = spark.createDataFrame([("kitob.v2.PDF",), ("x",)], "n string")
    assert [(r.t, r.m) for r in df.select(C.title_of(F.col("n")).alias("t"), C.media_type(F.col("n")).alias("m")).collect()] == [("kitob.v2", "application/pdf"), ("x", "application/octet-stream")]
    assert spark.createDataFrame([("uzb+eng",)], "l string").select(X.language_name(F.col("l")).alias("n")).first().n == "Oʻzbek (lotin) + English"


def test_style_inheritance(spark):
    rows = [("d", "a", None, "big", None), ("d", "b", "a", None, "red"), ("d", "c", "b", None, None), ("d", "x", "y", None, "blue"), ("d", "y", "x", "small", None)]
    got = {r.id: (r.size, r.color) for r in Q.inherited(spark.createDataFrame(rows, "doc string, id string, parent string, size string, color string"), ["size", "color"]).collect()}
    assert got == {"a": ("big", None), "b": ("big", "red"), "c": ("big", "red"), "x": ("small", "blue"), "y": ("small", "blue")}


def test_list_counters(spark):
    rows = [("d", i, 1, level) for i, level in enumerate([0, 1, 1, 2, 0, 1, 2, 2])]
    got = [r.prefix for r in Q.numbered(spark.createDataFrame(rows, "doc string, pos int, num int, level int")).orderBy("pos").collect()]
    assert got == ["1.", "a)", "b)", "i.", "2.", "a)", "i.", "ii."]


def test_bold_cells(spark):
    blocks = spark.createDataFrame([("p", 0, [("Katta uy", True), ("kichik", False)])], "project string, pos int, spans array<struct<text:string,bold:boolean>>")
    cells = spark.createDataFrame([("p", 0, "Katta uy"), ("p", 0, "Katta kichik"), ("q", 0, "x")], "project string, pos int, text string")
    assert {r.text: r.bold for r in Q.bold_cells(cells, blocks).collect()} == {"Katta uy": True, "Katta kichik": False, "x": False}


def test_rename_sheet(spark):
    df = spark.createDataFrame([("Old!A1+'Old'!B2+MyOld!C3",)], "f string")
    assert df.select(Q.rename_sheet(F.col("f"), "Old", "New one").alias("f")).first().f == "'New one'!A1+'New one'!B2+MyOld!C3"


def test_display(spark):
    df = spark.createDataFrame([(1234567.891,)], "x double")
    ask = lambda code: df.select(N.display(F.col("x"), code).alias("s")).first().s
    assert ask("#,##0.00") == "1 234 567.89" and ask("0.0") == "1234567.9" and ask("0%") == "123456789%" and ask('#,##0 "soʻm"') == "1 234 568 soʻm" and ask(None) == "1234567.891"
    day = spark.createDataFrame([(45323.5,)], "x double")
    assert day.select(N.display(F.col("x"), "dd.mm.yyyy").alias("s")).first().s == "01.02.2024" and day.select(N.display(F.col("x"), "dd.mm.yyyy h:mm").alias("s")).first().s == "01.02.2024 12:00"


def test_styled(spark):
    cells = spark.createDataFrame([("b", 1, "x"), ("b", 9, "y")], "book string, style int, raw string")
    one = lambda name: spark.createDataFrame([("b", 5, name)], f"book string, {name} int, {name}_name string")
    formats = spark.createDataFrame([("b", 1, 5, 5)], "book string, style int, font int, fill int")
    assert {r.raw: (r.font_name, r.fill_name) for r in Q.styled(cells, formats, one("font"), one("fill")).collect()} == {"x": ("font", "fill"), "y": (None, None)}
