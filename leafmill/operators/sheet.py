"""Worksheet operators over ``cells`` (book, sheet, row, col, raw, ...): sort, filter, reshape, shift, edits, joins of ranges."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.numbers import differs, parse_number
from leafmill.plans.staging import stage


def sort_keys(raw: Column, ascending: bool = True) -> list[Column]:
    """Q1: blanks last in both directions; numbers before texts, or after them descending; booleans as 1 and 0; texts without case."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    number = F.when(F.upper(text) == "TRUE", 1.0).when(F.upper(text) == "FALSE", 0.0).otherwise(F.when(text != "", parse_number(text)))
    rank = F.when(number.isNotNull(), 0).otherwise(1)
    way = (lambda c: c.asc_nulls_last()) if ascending else (lambda c: c.desc_nulls_last())
    return [F.when(text == "", 1).otherwise(0).asc(), way(rank), way(number), way(F.lower(F.when(number.isNull(), text).otherwise("")))]


def sort_rows(rows: DataFrame, column: str, ascending: bool = True, tie: str = "row") -> DataFrame:
    """Q1: rows by one column, stable by ``tie``."""
    return rows.orderBy(*sort_keys(F.col(column), ascending), F.col(tie).asc())


def sorted_positions(cells: DataFrame, col: int, ascending: bool = True, first_row: int = 1) -> DataFrame:
    """Where every row of each sheet goes: (book, sheet, row, to); rows above ``first_row`` stay.

    A sheet is ranked in one task: it is bounded by its 1,048,576 rows.
    """
    keyed = cells.groupBy("book", "sheet", "row").agg(F.max(F.when(F.col("col") == col, F.col("raw"))).alias("raw")).where(F.col("row") >= first_row)
    at = F.row_number().over(W.partitionBy("book", "sheet").orderBy(*sort_keys(F.col("raw"), ascending), "row")) - 1 + first_row
    return keyed.select("book", "sheet", "row", at.alias("to"))


def view_filter(rows: DataFrame, shown: str, text: str, row: str = "row") -> DataFrame:
    """Q2: rows whose shown text contains ``text`` in any case; row 0 is a header and stays."""
    return rows if not text else rows.where((F.col(row) < 1) | F.contains(F.lower(F.col(shown)), F.lit(text.lower())))


def shift(cells: DataFrame, axis: str, at: int, n: int) -> DataFrame:
    """Q4: ``n`` rows or columns inserted before ``at``, or with n < 0 as many deleted from there."""
    kept = cells if n > 0 else cells.where(~F.col(axis).between(at, at - n - 1))
    return kept.withColumn(axis, F.when(F.col(axis) >= at, F.col(axis) + n).otherwise(F.col(axis)))


def cards(cells: DataFrame) -> DataFrame:
    """Q5: cells below the header row with the header as ``label``; blanks are left out, columns without header take their letters."""
    from leafmill.functions.numbers import column_name

    head = cells.where("row = 0").select("book", "sheet", "col", F.col("raw").alias("label"))
    filled = cells.where("row > 0 and coalesce(raw, '') <> ''")
    return filled.join(head, ["book", "sheet", "col"], "left").select("book", "sheet", "row", "col", F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(column_name(F.col("col"))).alias("label"), F.col("raw").alias("value"))


def replace_all(text: Column, find: str, by: str, ignore_case: bool = False) -> Column:
    """Q6: (text, count) with every ``find`` replaced literally."""
    import re

    if not find:
        return F.struct(text.alias("text"), F.lit(0).alias("count"))
    pattern = ("(?iu)" if ignore_case else "") + re.sub(r"([\\.\[\](){}*+?^$|])", r"\\\1", find)
    new = F.regexp_replace(text, pattern, by.replace("\\", "\\\\").replace("$", "\\$"))
    return F.struct(new.alias("text"), F.regexp_count(text, F.lit(pattern)).alias("count"))


# The last row and column of a dense view.
DENSE_ROW, DENSE_COL = 10_000, 255


def dense(cells: DataFrame, last_row: int = DENSE_ROW, last_col: int = DENSE_COL) -> DataFrame:
    """Every cell of the rectangle up to the last filled one, at most to ``last_row`` and ``last_col``; missing cells as ''."""
    cells = cells.where((F.col("row") <= last_row) & (F.col("col") <= last_col))
    filled = cells.where("coalesce(raw, '') <> ''").groupBy("book", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    grid = filled.select("book", "sheet", F.explode(F.sequence(F.lit(0), "rows")).alias("row"), "cols").select("book", "sheet", "row", F.explode(F.sequence(F.lit(0), "cols")).alias("col"))
    return grid.join(cells.select("book", "sheet", "row", "col", "raw"), ["book", "sheet", "row", "col"], "left").withColumn("raw", F.coalesce("raw", F.lit("")))


def apply_edits(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Q14: ``edits`` (book, sheet, row, col, raw, ord) over ``cells``; the last edit of a cell holds, a null raw clears it."""
    key = ["book", "sheet", "row", "col"]
    last = edits.groupBy(*key).agg(F.max_by(F.struct("raw"), "ord").alias("e"))
    return cells.select(*key, "raw").join(last, key, "full").select(*key, F.when(F.col("e").isNotNull(), F.col("e.raw")).otherwise(F.col("raw")).alias("raw")).where("raw is not null")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Q22: cells whose number differs by more than the tolerance, or that are on one side only."""
    key = ["book", "sheet", "row", "col"]
    both = old.select(*key, F.col("value").alias("old")).join(new.select(*key, F.col("value").alias("new")), key, "full")
    return both.where(F.col("old").isNull() | F.col("new").isNull() | differs(F.col("old"), F.col("new")))


def shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Cells of type ``s`` take the shared string of their index; an index out of range leaves the raw value."""
    index = F.when(F.col("kind") == "s", F.col("raw").try_cast("int"))
    return cells.withColumn("idx", index).join(strings, ["book", "idx"], "left").withColumn("raw", F.coalesce("string", "raw")).drop("idx", "string")


def range_values(ranges: DataFrame, cells: DataFrame, block: int = 256) -> DataFrame:
    """Cells within ranges (id, book, sheet, r0, r1, c0, c1): an equality join on row blocks, then the exact bounds.

    A range goes to the row blocks that it covers, so no range meets cells of other blocks.
    """
    spread = ranges.withColumn("blk", F.explode(F.sequence(F.floor(F.col("r0") / block), F.floor(F.col("r1") / block))))
    return spread.join(cells.withColumn("blk", F.floor(F.col("row") / block)), ["book", "sheet", "blk"]).where("row between r0 and r1 and col between c0 and c1").drop("blk")


def uncovered(cells: DataFrame, merges: DataFrame, block: int = 256) -> DataFrame:
    """Cells that no merged range covers, its first cell excepted."""
    spread = merges.select("book", "sheet", "r0", "r1", "c0", "c1", F.explode(F.sequence(F.floor(F.col("r0") / block), F.floor(F.col("r1") / block))).alias("blk"))
    c = cells.withColumn("blk", F.floor(F.col("row") / block)).alias("c")
    m = spread.alias("m")
    inside = F.expr("c.book = m.book and c.sheet = m.sheet and c.blk = m.blk and c.row between m.r0 and m.r1 and c.col between m.c0 and m.c1 and not (c.row = m.r0 and c.col = m.c0)")
    return c.join(m, inside, "left_anti").drop("blk")


def overlapping(a: DataFrame, b: DataFrame, block: int = 256) -> DataFrame:
    """Pairs of ranges of one sheet that overlap: an equality join on blocks of rows and columns, of which a pair counts in the first that both cover."""
    across = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor(F.col(hi) / block)))
    a, b = (x.withColumn("blk", across("r0", "r1")).withColumn("blk_c", across("c0", "c1")).alias(n) for x, n in ((a, "a"), (b, "b")))
    same = F.expr("a.book = b.book and a.sheet = b.sheet and a.blk = b.blk and a.blk_c = b.blk_c and a.r0 <= b.r1 and a.r1 >= b.r0 and a.c0 <= b.c1 and a.c1 >= b.c0 and a.id < b.id")
    first = F.expr(f"a.blk = floor(greatest(a.r0, b.r0) / {block}) and a.blk_c = floor(greatest(a.c0, b.c0) / {block})")
    return a.join(b, same & first).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))


def nearest(xs: DataFrame, columns: Column) -> Column:
    """Index of the value of the array ``columns`` nearest to ``x``; the first of equals."""
    return F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(c - F.col("x")).alias("d"), i.alias("i")))).getField("i")


def column_starts(xs: Column, gap: int = 40) -> Column:
    """Q18: cluster starts of an array of positions: a new one where a position is more than ``gap`` from the last start."""
    return F.aggregate(F.array_sort(xs), F.expr("cast(array() as array<int>)"), lambda done, x: F.when((F.size(done) == 0) | (x - F.try_element_at(done, F.lit(-1)) > gap), F.concat(done, F.array(x))).otherwise(done))


def increasing(columns: Column) -> Column:
    """Q19: column numbers kept increasing: one that is not beyond the last becomes the next."""
    return F.aggregate(columns, F.expr("cast(array() as array<int>)"), lambda done, c: F.concat(done, F.array(F.greatest(c, F.coalesce(F.try_element_at(done, F.lit(-1)) + 1, F.lit(0))))))




def word_rows(words: DataFrame) -> DataFrame:
    """Q16: words (project, pos, t, x, w, b, s) with their printed ``line``: a new one where the baseline differs from the word before by more than max(3, s / 2)."""
    by = W.partitionBy("project", "pos").orderBy("b", "x", "i")
    prev = F.lag("b").over(by)
    new = (prev.isNull() | (F.abs(prev - F.col("b")) > F.greatest(F.lit(3), F.floor(F.col("s") / 2)))).cast("int")
    return words.withColumn("new", new).withColumn("line", F.sum("new").over(by) - 1).drop("new")


def line_cells(rows: DataFrame) -> DataFrame:
    """Q17: (project, pos, line, cell, x, text): a cell ends where the gap to the next word exceeds 1.3 times its size."""
    by = W.partitionBy("project", "pos", "line").orderBy("x", "i")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(by)
    marked = rows.withColumn("cell", F.sum(F.coalesce((gap > 1.3 * F.col("s")).cast("int"), F.lit(0))).over(by))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "i", "t"))), lambda s: s["t"]), " ")
    return marked.groupBy("project", "pos", "line", "cell").agg(F.min("x").alias("x"), texts.alias("text"))


def is_table_number(text: Column) -> Column:
    """K3: what the XLSX writer stores as a number."""
    return F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).rlike(r"^-?\d{1,12}(\.\d+)?$")




def paste(cells: DataFrame, r0: int, c0: int, r1: int, c1: int, to_row: int, to_col: int) -> DataFrame:
    """Q20: a range pasted with its formulas translated; targets outside the grid are left out."""
    from leafmill.operators.formula import translated

    dr, dc = to_row - r0, to_col - c0
    source = cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    moved = source.withColumn("formula", F.when(F.col("formula").isNotNull(), translated("formula", F.lit(dr), F.lit(dc)))).withColumn("row", F.col("row") + dr).withColumn("col", F.col("col") + dc)
    return moved.where("row >= 0 and col >= 0")


def outline(paragraphs: DataFrame) -> DataFrame:
    """Q24: non-empty paragraph texts of each slide in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    return paragraphs.where("trim(coalesce(text, '')) <> ''").groupBy("doc", "slide").agg(texts.alias("texts"))


def inherited(styles: DataFrame, fields: list[str], deepest: int = 10) -> DataFrame:
    """Styles (doc, id, parent, fields...) with each missing field from the nearest ancestor that has it; cycles and depths beyond ten end the search.

    One join a level over all documents at once; it stops as soon as no style has an ancestor left, each level being staged.
    """
    own = styles.select("doc", "id", "parent", *fields)
    up = own.select("doc", F.col("id").alias("parent"), F.col("parent").alias("_next"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = own.withColumn("_seen", F.array("id"))
    for _ in range(deepest):
        if out.where("parent is not null").isEmpty():
            break
        out = stage(out.join(up, ["doc", "parent"], "left").select(
            "doc", "id", F.when(~F.array_contains("_seen", F.coalesce("_next", F.lit(""))), F.col("_next")).alias("parent"), *[F.coalesce(f, f"_{f}").alias(f) for f in fields], F.concat("_seen", F.array(F.coalesce("_next", F.lit("")))).alias("_seen")
        ))
    return out.select("doc", "id", *fields)


def numbered(paragraphs: DataFrame) -> DataFrame:
    """List prefixes of paragraphs (doc, pos, num, level): counters of a level begin anew after a higher one.

    A counter is the number of paragraphs of its level since the last one of a higher level, so a window per list replaces the state.
    """
    from leafmill.functions.text import roman

    by = W.partitionBy("doc", "num").orderBy("pos")
    out = paragraphs
    for level in range(3):
        out = out.withColumn(f"_run{level}", F.sum((F.col("level") < level).cast("int")).over(by))
    count = None
    for level in range(3):
        own = F.sum((F.col("level") == level).cast("int")).over(W.partitionBy("doc", "num", f"_run{level}").orderBy("pos"))
        count = F.when(F.col("level") == level, own) if count is None else count.when(F.col("level") == level, own)
    letter = F.char((F.col("count") - 1) % 26 + 97)
    prefix = F.when(F.col("level") == 0, F.concat(F.col("count").cast("string"), F.lit("."))).when(F.col("level") == 1, F.concat(letter, F.lit(")"))).otherwise(F.concat(roman(F.col("count")), F.lit(".")))
    return out.withColumn("count", count).withColumn("prefix", prefix).drop("_run0", "_run1", "_run2")


def styled(cells: DataFrame, formats: DataFrame, fonts: DataFrame, fills: DataFrame) -> DataFrame:
    """Cells with the font and fill of their style; missing indexes leave them null."""
    return cells.join(formats, ["book", "style"], "left").join(fonts, ["book", "font"], "left").join(fills, ["book", "fill"], "left")


def bold_cells(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Whether every word of a cell (project, pos, line, cell, text) stands in a bold span of its page."""
    words = blocks.select("project", "pos", F.explode("spans").alias("s")).where("s.bold").select("project", "pos", F.explode(F.split("s.text", " ")).alias("t")).select("project", "pos", F.trim("t").alias("t")).distinct()
    own = words.groupBy("project", "pos").agg(F.collect_set("t").alias("bold_words"))
    known = lambda w: F.array_contains(F.coalesce("bold_words", F.array()), w)
    return cells.join(own, ["project", "pos"], "left").withColumn("bold", F.forall(F.split("text", " "), known)).drop("bold_words")


def rename_sheet(formula: Column, old: str, new: str) -> Column:
    """Q13: references to a sheet by its new name; names that are no words are quoted."""
    import re

    quoted = new if re.fullmatch(r"[A-Za-z_][\w.]*", new) else "'" + new.replace("'", "''") + "'"
    name = re.sub(r"([\\.\[\](){}*+?^$|])", r"\\\1", old)
    return F.regexp_replace(formula, f"(?i)(?<![\\w'.])(?:'{name}'|{name})!", quoted.replace("\\", "\\\\").replace("$", "\\$") + "!")
