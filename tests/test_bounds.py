"""Planted cases for bounds that once lost data, and for saving with a check."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions.text import decode_entities, sanitise
from leafmill.operators.formula import to_column
from leafmill.operators.layout import assemble
from leafmill.operators.sheet import dense, inherited, overlapping
from leafmill.sinks.writers import digests, save_verified
from leafmill.sources.formats import detect
from leafmill.streaming.shots import shots_batch


def test_paragraph_over_thousands_of_pages(spark):
    blocks = spark.range(4200).select(F.lit("p").alias("project"), F.col("id").cast("int").alias("pos"), F.lit(0).alias("idx"), F.lit("PARAGRAPH").alias("type"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(",")).alias("text"))
    got = assemble(blocks).collect()
    assert len(got) == 1 and got[0].text.split() == [f"w{i}," for i in range(4200)]


def test_entities_of_the_whole_code_space(spark):
    df = spark.createDataFrame([("&#128512;&#x1F600;&#65;",), ("&#55296;&#1114112;x",), (None,), ("",)], "t string")
    assert [r.d for r in df.select(decode_entities(F.col("t")).alias("d")).collect()] == ["😀😀A", "x", None, ""]


def test_frames_and_script_addresses(spark):
    df = spark.createDataFrame([("<frameset cols=2><frame src=a></frameset><a xlink:href='data:text/html,x'>y</a><a href=vbscript:z>w</a>",)], "h string")
    assert df.select(sanitise(F.col("h")).alias("h")).first().h == '<a xlink:href="#">y</a><a href="#">w</a>'


def test_arguments_of_if_come_first(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    columns = {"a": F.col("a"), "b": F.col("b")}
    assert [r.x for r in df.select(to_column('IF(COL("a")=1,1,1/COL("b"))', columns).alias("x")).collect()] == [None, 1.0]


def frame(ts, motion=0.5, sharp=50.0):
    return ("c", ts, motion, sharp, 100.0)


def test_midnight_and_repeated_frames(spark):
    start = dt.datetime(2024, 1, 1, 23, 59, 55)
    still = [frame(start + dt.timedelta(milliseconds=500 * i)) for i in range(40)]
    schema = "camera string, ts timestamp, motion double, sharp double, mean double"
    once = shots_batch(spark.createDataFrame(still, schema)).collect()
    assert len(once) == 1 and [r.ts for r in shots_batch(spark.createDataFrame(still * 3, schema)).collect()] == [once[0].ts]


def test_far_cell_is_beyond_a_dense_view(spark):
    cells = spark.createDataFrame([("b", 0, 1, 1, "x"), ("b", 0, 1_048_575, 16_383, "y")], "book string, sheet int, row int, col int, raw string")
    assert dense(cells).count() == 4


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    made = []
    for i in range(120):
        r, c = rng.randint(0, 900), rng.randint(0, 600)
        made.append((i, "b", i % 2, r, r + rng.randint(0, 400), c, c + rng.randint(0, 300)))
    df = spark.createDataFrame(made, "id int, book string, sheet int, r0 int, r1 int, c0 int, c1 int")
    expected = {(a[0], b[0]) for a in made for b in made if a[0] < b[0] and a[2] == b[2] and a[3] <= b[4] and a[4] >= b[3] and a[5] <= b[6] and a[6] >= b[5]}
    got = [tuple(r) for r in overlapping(df, df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_styles_of_many_levels_and_cycles(spark):
    rows = [("d", "a", None, "1"), ("d", "b", "a", None), ("d", "c", "b", None), ("d", "x", "y", None), ("d", "y", "x", None)]
    got = {r.id: r.size for r in inherited(spark.createDataFrame(rows, "doc string, id string, parent string, size string"), ["size"]).collect()}
    assert got == {"a": "1", "b": "1", "c": "1", "x": None, "y": None}


def test_a_part_is_a_name_in_the_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("readme.txt", "see word/document.xml and xl/workbook.xml")
    assert detect(out.getvalue(), "UNKNOWN") == "UNKNOWN"
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
    assert detect(out.getvalue(), "UNKNOWN") == "XLSX"


def test_saved_files_are_checked(spark, tmp_path):
    path = str(tmp_path / "files")
    first = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", None)], "name string, content binary")
    opened = save_verified(first, path)
    held = [tuple(r) for r in opened.collect()]
    assert sorted(held, key=str) == sorted([tuple(r) for r in digests(first).collect()], key=str)
    kept = spark.createDataFrame(held, "name string, digest string")
    changed = spark.createDataFrame([("a", bytearray(b"9")), ("b", bytearray(b"2"))], "name string, content binary")
    save_verified(changed, path, kept)
    with pytest.raises(FileExistsError, match="'a'"):
        save_verified(first, path, kept)
