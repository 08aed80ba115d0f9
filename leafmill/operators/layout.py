"""Statistics and reconstruction of page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import HYPHENS, key, starts_lower
from leafmill.plans.staging import stage


def weighted_quantile(rows: DataFrame, group: list[str], value: str, weight: str, q: float = 0.5) -> DataFrame:
    """The first value, in order, whose running weight reaches ``q`` of the group's.

    Equal values are added up first, so a group's rows come down to its distinct values before the window.
    """
    by_value = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(weight).alias("wt"))
    running = F.sum("wt").over(W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("wt").over(W.partitionBy(*group))
    marked = by_value.withColumn("_at", running).withColumn("_all", total)
    return marked.where(F.col("_at") >= F.lit(q) * F.col("_all")).groupBy(*group).agg(F.min(value).alias("quantile"))


def percentile(rows: DataFrame, group: list[str], value: str, p: float) -> DataFrame:
    """The element at int((n - 1) p) of the sorted values, with the product in single precision as it is defined."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    n = F.sum("k").over(W.partitionBy(*group))
    marked = counted.withColumn("_upto", upto).withColumn("_n", n)
    at = F.floor((F.col("_n") - 1).cast("float") * F.lit(p).cast("float"))
    return marked.where(F.col("_upto") > at).groupBy(*group).agg(F.min(value).alias("percentile"))


def average_size(lines: DataFrame, group: list[str]) -> DataFrame:
    """Mean line size weighted by words; 0 for no words."""
    n = F.sum("words")
    return lines.groupBy(*group).agg(F.when(n == 0, 0.0).otherwise(F.sum(F.col("size") * F.col("words")) / F.when(n != 0, n)).alias("size"))


def bold_words(words: DataFrame, sensitivity: float = 0.5) -> DataFrame:
    """A word is bold if its stroke by x-height exceeds the page's 0.35 quantile (by letters) by the factor 1.42 - 0.30 sensitivity.

    Pages with fewer than four measured words have none; unmeasured words are undecided (null).
    """
    measured = words.where("stroke is not null")
    reference = weighted_quantile(measured, ["page"], "stroke", "letters", 0.35)
    enough = measured.groupBy("page").agg(F.count("*").alias("n")).where("n >= 4")
    joined = words.join(reference.join(enough, "page"), "page", "left")
    return joined.withColumn("bold", F.when(F.col("quantile").isNull(), False).when(F.col("stroke").isNotNull(), F.col("stroke") > F.col("quantile") * F.lit(1.42 - 0.30 * sensitivity))).drop("quantile", "n")


def smooth_bold(words: DataFrame, line: list[str]) -> DataFrame:
    """Undecided words follow their decided neighbours (both must be bold; one alone decides), then lone gaps are filled and lone short bold words cleared."""
    by = W.partitionBy(*line).orderBy("i")
    before = F.last("bold", True).over(by.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("bold", True).over(by.rowsBetween(1, W.unboundedFollowing))
    decided = words.withColumn("bold", F.coalesce("bold", F.when(before.isNotNull() & after.isNotNull(), before & after).otherwise(F.coalesce(before, after, F.lit(False)))))
    left, right = F.lag("bold").over(by), F.lead("bold").over(by)
    filled = decided.withColumn("bold", F.when(~F.col("bold") & left & right, True).otherwise(F.col("bold")))
    left, right = F.lag("bold").over(by), F.lead("bold").over(by)
    alone = F.col("bold") & ~F.coalesce(left, F.lit(False)) & ~F.coalesce(right, F.lit(False)) & (F.length("t") <= 3) & (left.isNotNull() | right.isNotNull())
    return filled.withColumn("bold", F.when(alone, False).otherwise(F.col("bold")))


def merge_spans(spans: Column) -> Column:
    """Neighbouring spans of one style as one."""
    empty = F.expr("cast(array() as array<struct<text:string,bold:boolean,italic:boolean>>)")

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = last.isNotNull() & (last["bold"] == s["bold"]) & (last["italic"] == s["italic"])
        joined = F.struct(F.concat(last["text"], s["text"]).alias("text"), s["bold"].alias("bold"), s["italic"].alias("italic"))
        own = F.struct(s["text"].alias("text"), s["bold"].alias("bold"), s["italic"].alias("italic"))
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(own)))

    return F.aggregate(F.coalesce(spans, empty), empty, step)


def can_join(prev: Column, text: Column) -> Column:
    """Whether a paragraph goes on in the next: after a hyphen, or before a small letter or after a comma if no sentence ends."""
    a, b = F.regexp_replace(prev, r"\s+$", ""), F.ltrim(text)
    ended = a.rlike(r"[.!?…]$|[.!?…][»\"”]$")
    return F.when(F.coalesce(F.length(a) * F.length(b), F.lit(0)) == 0, False).when(a.rlike(f"[{HYPHENS}]$"), True).when(ended, False).when(b.rlike(r"\p{L}"), starts_lower(b) | a.endswith(",")).otherwise(False)


def joined_text(prev: Column, text: Column) -> Column:
    """Both texts as one; the hyphen of a broken word goes away."""
    a, b = F.rtrim(prev), F.ltrim(text)
    return F.when(a.rlike(rf"\p{{L}}[{HYPHENS}]$") & starts_lower(b), F.concat(F.regexp_replace(a, f"[{HYPHENS}]$", ""), b)).otherwise(F.concat(a, F.lit(" "), b))


def assemble(blocks: DataFrame) -> DataFrame:
    """Blocks (project, pos, idx, type, text) as paragraphs over pages: (project, pos, idx, type, text) of where each begins.

    Only the first block of a page may go on from the last block of the page before, so only page edges are compared; a
    chain over whole pages is followed by doubling its steps.
    """
    page = W.partitionBy("project", "pos").orderBy("idx")
    marked = blocks.where("type <> 'IMAGE'").withColumn("n", F.row_number().over(page)).withColumn("of", F.count("*").over(W.partitionBy("project", "pos")))
    last = marked.where("n = of").select("project", (F.col("pos") + 1).alias("pos"), F.col("text").alias("prev"), F.col("type").alias("prev_type"), F.col("of").alias("prev_of"))
    first = marked.where("n = 1").join(last, ["project", "pos"], "left")
    goes = (F.col("type") == "PARAGRAPH") & (F.col("prev_type") == "PARAGRAPH") & can_join(F.col("prev"), F.col("text"))
    edges = first.select("project", "pos", F.coalesce(goes, F.lit(False)).alias("goes"), (F.col("prev_of") == 1).alias("through"))
    # the page where the block that page `pos` goes on from begins
    heads = edges.select("project", "pos", F.when(F.col("goes"), F.col("pos") - 1).otherwise(F.col("pos")).alias("head"), (F.col("goes") & F.col("through")).alias("open"))
    heads = stage(heads)
    while not heads.where("open").isEmpty():  # hardly ever a single step; every step doubles the pages that are passed
        back = heads.select("project", F.col("pos").alias("head"), F.col("head").alias("head2"), F.col("open").alias("open2"))
        heads = heads.join(back, ["project", "head"], "left").select("project", "pos", F.when(F.col("open"), F.coalesce("head2", "head")).otherwise(F.col("head")).alias("head"), (F.col("open") & F.coalesce("open2", F.lit(False))).alias("open"))
        heads = stage(heads)
    placed = marked.join(heads.select("project", "pos", "head"), ["project", "pos"])
    start = F.when((F.col("n") == 1) & (F.col("head") < F.col("pos")), F.struct(F.col("head").alias("pos"), F.lit(-1).alias("idx"))).when((F.col("n") == F.col("of")), F.struct("pos", F.lit(-1).alias("idx"))).otherwise(F.struct("pos", "idx"))
    pieces = F.array_sort(F.collect_list(F.struct("pos", "idx", "text")))
    text = F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), F.get(pieces, F.lit(0))["text"], lambda a, s: joined_text(a, s["text"]))
    at = F.get(pieces, F.lit(0))
    return placed.withColumn("start", start).groupBy("project", "start").agg(F.first("type").alias("type"), at["pos"].alias("pos"), at["idx"].alias("idx"), text.alias("text")).select("project", "pos", "idx", "type", "text")


def running_heads(blocks: DataFrame, least_pages: int = 2, least_share: float = 0.3) -> DataFrame:
    """D16 by equal keys: (project, key, pages) of the first, second and last text blocks that stand on enough pages of their project."""
    down, up = W.partitionBy("project", "pos").orderBy("idx"), W.partitionBy("project", "pos").orderBy(F.col("idx").desc())
    edge = blocks.where("type <> 'IMAGE'").withColumn("d", F.row_number().over(down)).withColumn("u", F.row_number().over(up)).where("d <= 2 or u = 1")
    keyed = edge.select("project", "pos", key(F.col("text")).alias("key")).where(F.length("key").between(6, 90)).distinct()
    of = blocks.select("project", "pos").distinct().groupBy("project").agg(F.count("*").alias("of"))
    n = keyed.groupBy("project", "key").agg(F.count("*").alias("pages"))
    return n.join(of, "project").where((F.col("pages") >= least_pages) & (F.col("pages") >= F.lit(least_share) * F.col("of"))).select("project", "key", "pages")


def similar(a: Column, b: Column) -> Column:
    """Apart by at most a fifth of the longer."""
    return F.levenshtein(a, b) <= F.greatest(F.length(a), F.length(b)) * 0.2


def without_heads(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """Blocks that are a head fall away; those that begin with one lose it, up to a word's end.

    ``heads`` (project, key) are few for each project; they come to the blocks as one array, so no pairs are made.
    """
    own = heads.groupBy("project").agg(F.array_sort(F.collect_set("key")).alias("heads"))
    k = key(F.col("text"))
    head = F.get(F.filter("heads", lambda h: (F.length(k) >= F.length(h) * 0.75) & similar(F.substring(k, F.lit(1), F.length(h)), h)), F.lit(0))
    joined = blocks.join(own, "project", "left").withColumn("head", F.when(F.col("type") != "IMAGE", head))
    kept = joined.where(F.col("head").isNull() | (F.length(k) > F.length("head") * 1.3))
    chars = F.split("text", "")
    cut = F.aggregate(chars, F.struct(F.lit(0).alias("letters"), F.lit(0).alias("cut")), lambda a, c: F.struct(F.when(a["letters"] < F.length("head"), a["letters"] + c.rlike(r"\p{L}").cast("int")).otherwise(a["letters"]).alias("letters"), F.when(a["letters"] < F.length("head"), a["cut"] + 1).otherwise(a["cut"]).alias("cut")))["cut"]
    rest = F.regexp_replace(F.regexp_replace(F.substring("text", cut + 1, F.length("text")), r"^\S+", ""), r"^[ ,.;:—-]+", "")
    return kept.withColumn("text", F.when(F.col("head").isNotNull(), rest).otherwise(F.col("text"))).drop("head", "heads")


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """text of pages (doc, pos, text) as paragraphs: blank lines and short lines that end a sentence close one; hyphens before small letters go."""
    lines = pages.select("doc", "pos", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    by = W.partitionBy("doc", "pos").orderBy("n")
    ends = (F.col("line") == "") | ((F.length("line") < 45) & F.col("line").rlike(r"[.!?:]$"))
    marked = lines.withColumn("par", F.coalesce(F.sum(ends.cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("line <> ''")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"])
    text = F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), F.get(pieces, F.lit(0)), lambda a, s: F.when(a.endswith("-") & s.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), s)).otherwise(F.concat(a, F.lit(" "), s)))
    made = marked.groupBy("doc", "pos", "par").agg(text.alias("text"))
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    short = (F.length("text") < 70) & ~F.col("text").endswith(".") & (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) < 10)
    return made.withColumn("type", F.when(short & (letters != "") & (letters == F.upper(letters)), "HEADING2").otherwise("PARAGRAPH"))


def contents(blocks: DataFrame) -> DataFrame:
    """Titles with level and block ordinal, for books of at least two headings."""
    heads = blocks.where("type in ('HEADING1', 'HEADING2')").select("project", "pos", "idx", F.when(F.col("type") == "HEADING1", 1).otherwise(2).alias("level"), F.col("text").alias("title"))
    enough = heads.groupBy("project").agg(F.count("*").alias("n")).where("n >= 2").select("project")
    return heads.join(enough, "project", "left_semi")


def mean_confidence(words: DataFrame) -> DataFrame:
    """Mean confidence of the paragraphs of a page, without fragments (fewer than 3 letters, or fewer than 8 with less than 70)."""
    par = words.groupBy("page", "par").agg(F.sum(F.regexp_count("text", F.lit(r"\p{L}"))).alias("letters"), F.avg("conf").alias("conf"), F.sum("conf").alias("sum"), F.count("*").alias("n"))
    kept = par.where(~((F.col("letters") < 3) | ((F.col("letters") < 8) & (F.col("conf") < 70))))
    return kept.groupBy("page").agg((F.sum("sum") / F.sum("n")).alias("confidence"))
