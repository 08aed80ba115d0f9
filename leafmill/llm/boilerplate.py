"""Problem 3: printed lines repeated across the pages of one project.

Every line becomes a template in a token tree of fixed depth: project and number of words, then
the wildcard slot, then the words outside it. The first level of slots takes half of the words, so
a line with one misread word still meets its fellows in one of its two leaves. Leaves are counted
with map-side aggregation and merged by their path; only templates in leaves on three or more
pages are refined by slots of one word and either end of that word, where each is joined to the slot's most frequent template.
Templates joined directly or by way of others are one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.pagelines import page_lines
from leafmill.plans.staging import small, stage, table

MIN_LETTERS, MIN_PAGES, MIN_SHARE = 15, 3, 0.2
#: Letters at either end of a word by which the templates of a slot are told apart, and of a line's only word.
_ENDS, _LONE = 2, 6
#: A misread word hides at most so many of a line's letters, or all of them and is a ``#`` of its template.
_HIDDEN = 4


def _places(words: Column, sides: Column) -> Column:
    """(rest, word, ends) of the places of a template: a hash of all other words, the word in it and either end of that; a lone word's ends are longer.

    ``sides`` has bit 1 if the first half of the template is shared, and bit 2 if the second is; a misread word is in the other half.
    """
    rest = lambda i: F.array_join(F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words))), " ")

    def at(word: Column, i: Column) -> Column:
        lone, n = F.size(words) == 1, F.length(word)
        end = lambda k: F.array(F.concat(F.lit("^"), F.left(word, F.lit(k))), F.concat(F.right(word, F.lit(k)), F.lit("$")))
        # words that a letter more or less takes over the bound have slots on both sides of it
        short, none = F.when((n <= 2 * _ENDS + 1) & ~lone, end(1)), F.array().cast("array<string>")
        ends = F.concat(F.coalesce(short, none), F.when(lone, end(_LONE)).when(n >= 2 * _ENDS, end(_ENDS)).otherwise(none))
        wanted = lone | (sides.bitwiseAND(F.when(2 * i < F.size(words), 2).otherwise(1)) != 0)
        return F.when(wanted, F.struct(F.xxhash64(i, F.size(words), rest(i)).alias("rest"), word.alias("word"), ends.alias("ends")))

    return F.transform(words, at)


def repeated_templates(lines: DataFrame, pages_of: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(path) of the templates that stand on many pages of their project; a path names its project too.

    ``lines`` are rows of ``page_lines``; ``pages_of`` has ``project`` and its number of pages ``of``. Pages are counted
    once however often a line or a page is repeated. The letters of templates that are one line are those of its longest form, so that misreadings hide none. Ties between templates of one slot go to the smaller path.
    """
    whole = (F.col("letters") >= min_letters - _HIDDEN) | F.contains("key", F.lit("#"))
    long = lines.where((F.col("b") >= 0) & (F.col("tokens") > 0) & whole)
    both = F.explode(F.array("front", "back")).alias("leaf")
    leaves = (
        long.select("pos", "letters", both).groupBy("leaf").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("letters").alias("letters"))
        .where((F.col("n") >= min_pages) & (F.col("lo") < F.col("hi")) & (F.col("letters") >= min_letters)).select("leaf")
    )
    leaves = small(leaves)
    sided = F.explode(F.array(F.struct(F.col("front").alias("leaf"), F.lit(1).alias("side")), F.struct(F.col("back").alias("leaf"), F.lit(2).alias("side")))).alias("l")
    near = long.select("project", "pos", "path", "key", "letters", sided).select("project", "pos", "path", "key", "letters", "l.*").join(leaves, "leaf", "left_semi")
    at = stage(near.groupBy("project", "path", "pos", "key").agg(F.max("letters").alias("letters"), F.bit_or("side").alias("sides")))
    keys = at.groupBy("project", "path", "key").agg(F.count("*").alias("pages"), F.bit_or("sides").alias("sides"))
    places = keys.select("project", "path", "pages", F.explode(_places(F.split("key", " "), F.col("sides"))).alias("s")).where("s is not null").select("project", "path", "pages", "s.*")
    slots = stage(places.select("project", "path", "pages", "word", "rest", F.explode("ends").alias("end")).select("project", "path", "pages", "word", F.xxhash64("rest", "end").alias("slot")))
    top = F.max(F.struct("pages", (-F.col("path")).alias("less"), "path", "word"))
    tops = slots.groupBy("project", "slot").agg(top.alias("top"), F.count("*").alias("n")).where("n > 1").select("project", "slot", F.col("top.path").alias("root"), F.col("top.pages").alias("root_pages"), F.col("top.word").alias("root_word"))
    apart = F.levenshtein("word", "root_word")
    longer = F.length("word") - F.length("root_word")  # a letter misread as a group of letters
    links = slots.join(tops, ["project", "slot"]).where((F.col("path") != F.col("root")) & (apart <= F.when(longer == 2, 3).when((F.length("root_word") <= 3) & (longer != 1), 1).otherwise(2))).select("path", "root").distinct()
    roots = groups_of(stage(links))
    rooted = at.join(roots, "path", "left").select("project", "path", "pos", "letters", F.coalesce("root", "path").alias("root"))
    groups = rooted.select("project", "root", "pos", "letters").groupBy("project", "root", "pos").agg(F.max("letters").alias("letters")).groupBy("project", "root").agg(F.count("*").alias("pages"), F.max("letters").alias("letters"))
    held = groups.join(pages_of, "project").where((F.col("pages") >= min_pages) & (F.col("pages") >= F.lit(min_share) * F.col("of")) & (F.col("letters") >= min_letters)).select("project", "root")
    return rooted.select("project", "path", "root").distinct().join(held, ["project", "root"], "left_semi").select("path")


def groups_of(links: DataFrame) -> DataFrame:
    """(path, root): every path of ``links`` (path, root) with the least path that it hangs together with, by however many links.

    Each round gives a path the least label of its neighbours and then that label's own one, so that chains shrink by doubling; it ends when nothing changes.
    """
    both = stage(links.unionByName(links.select(F.col("root").alias("path"), F.col("path").alias("root"))).distinct())
    labels = stage(both.groupBy("path").agg(F.least(F.min("root"), F.min("path")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("path").alias("root"), "label"), "root").groupBy("path").agg(F.min("label").alias("heard"))
        closer = labels.join(heard, "path").select("path", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jumped = closer.join(labels.select(F.col("path").alias("label"), F.col("label").alias("further")), "label", "left")
        new = stage(jumped.select("path", "old", F.least("label", "further").alias("label")))
        done = new.where("label <> old").isEmpty()
        labels = new.drop("old")
        if done:
            return labels.withColumnRenamed("label", "root")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.select("project", "pos").distinct().groupBy("project").agg(F.count("*").alias("of"))


def repeated_lines(lines: DataFrame, pages: DataFrame, **limits) -> DataFrame:
    """The rows of ``lines`` whose template is repeated across their project; each row once."""
    found = small(repeated_templates(lines, page_counts(pages), **limits))
    return lines.where("tokens > 0").join(found, "path", "left_semi")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "ocr_page")
    lines = stage(page_lines(pages))
    return repeated_lines(lines, pages).where("b >= 0").select("project", "pos", "b").distinct()


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page without the repeated lines: ``project``, ``pos``, ``words`` left in order; pages without words give an empty list."""
    pages = table(spark, sf_dir, "ocr_page")
    lines = stage(page_lines(pages))
    gone = repeated_lines(lines, pages).groupBy("project", "pos").agg(F.collect_set("b").alias("gone"))
    return pages.select("project", "pos", "words").dropDuplicates(["project", "pos"]).join(gone, ["project", "pos"], "left").select(
        "project", "pos", F.filter(F.coalesce("words", F.array()), lambda w: ~F.array_contains(F.coalesce(F.col("gone"), F.array()), w["b"])).getField("t").alias("words")
    )
