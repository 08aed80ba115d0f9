"""Problem 1: text that looks the same but is stored with other characters.

Every distinct string is exploded to positioned code points; broadcast joins give each its
decomposition (invisible marks have none) and its letter of the same shape; combining marks
are ordered by class, composed again, and the strings rebuilt. Only distinct strings are
exploded, after map-side aggregation, so the exploded rows grow with the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import glyphs
from leafmill.plans.staging import small, stage, table

EDGE = r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"


def strip_edges(t: Column) -> Column:
    """A word without punctuation and signs at both ends."""
    return F.regexp_replace(t, EDGE, "")


def block_text(spans: Column) -> Column:
    """A block's text: its spans' texts one after the other; null spans give ''."""
    return F.concat_ws("", F.transform(F.coalesce(spans, F.array()), lambda s: s["text"]))


def _parts_table(spark: SparkSession) -> DataFrame:
    """Bounded by Unicode: about 7,000 rows."""
    marks = glyphs.combining_classes()
    shown = {c: p for c, p in glyphs.decompositions()}
    for c in [*glyphs.TO_LATIN, *glyphs.TO_CYRILLIC, *marks]:
        shown.setdefault(c, c)
    rows = [(c, [(p, marks.get(p, 0), glyphs.TO_LATIN.get(p, p)) for p in parts]) for c, parts in shown.items()]
    return spark.createDataFrame(rows, "ch string, parts array<struct<o string, cls int, look string>>")


#: Texts of these signs alone stay as they are.
_PLAIN = r"^[ !-&(-_a-~]*$"
_JAMO = r"[\u1100-\u1112\uAC00-\uD7A3][\u1161-\u1175\u11A8-\u11C2]"


def _composed(parts: Column) -> Column:
    """A cluster's ``parts`` (c, cls), a starter and its marks in order, composed: every mark joins the starter where a pair is known, unless a mark left between them blocks it."""
    pairs = F.create_map(*[F.lit(x) for pair in glyphs.compositions().items() for x in pair])

    def step(done: Column, p: Column) -> Column:
        whole = F.try_element_at(pairs, F.concat(done["starter"], p["c"]))
        joins = whole.isNotNull() & ((done["rest"] == "") | (done["cls"] < p["cls"]))
        return F.struct(
            F.when(joins, whole).otherwise(done["starter"]).alias("starter"), F.when(joins, done["rest"]).otherwise(F.concat(done["rest"], p["c"])).alias("rest"), F.when(joins, done["cls"]).otherwise(p["cls"]).alias("cls")
        )

    first = F.get(parts, F.lit(0))
    empty = F.struct(first["c"].alias("starter"), F.lit("").alias("rest"), F.lit(0).alias("cls"))
    folded = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), empty, step, lambda done: F.concat(done["starter"], done["rest"]))
    return F.when(F.size(parts) == 1, first["c"]).when(first["cls"] != 0, F.array_join(F.transform(parts, lambda p: p["c"]), "")).otherwise(folded)


def _syllables(text: Column) -> Column:
    """Letters of Hangul as the syllables that they compose to; a syllable's number is that of its letters."""
    code = lambda c: F.when(c == "", 0).otherwise(F.ascii(c))

    def step(done: Column, c: Column) -> Column:
        a, b = code(done["last"]), code(c)
        lv = a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175)
        lvt = a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(0x11A8, 0x11C2)
        number = F.when(lv, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28).otherwise(a + (b - 0x11A7))
        # the three bytes of the character in UTF-8
        whole = F.decode(F.unhex(F.lpad(F.hex(F.lit(0xE08080) + F.shiftright(number, 12) * 65536 + F.shiftright(number, 6) % 64 * 256 + number % 64), 6, "0")), "UTF-8")
        joins = lv | lvt
        return F.struct(F.when(joins, done["text"]).otherwise(F.concat(done["text"], done["last"])).alias("text"), F.when(joins, whole).otherwise(c).alias("last"))

    empty = F.struct(F.lit("").alias("text"), F.lit("").alias("last"))
    return F.when(text.rlike(_JAMO), F.aggregate(F.split(text, ""), empty, step, lambda done: F.concat(done["text"], done["last"]))).otherwise(text)


def canonical(strings: DataFrame, column: str) -> DataFrame:
    """One row per distinct non-null value of ``column``: ``raw``, ``canon`` (its one form), ``look`` (its shape).

    ``canon`` is decomposed, without invisible marks, with plain blanks, marks in class order,
    composed again, apostrophe-like signs as ʻ after o and g and as ʼ elsewhere, and with each run
    of letters in the script of most of its unambiguous letters. ``look`` is ``canon`` with letters of one
    shape as Latin letters: two texts look the same exactly if their ``look`` is equal. An empty string
    gives empty strings, a string of invisible marks too; nulls give no row; equal strings give one row; other
    columns of ``strings`` are not read. Code points carry a number for their text, so that their bytes grow with a text's length.
    """
    spark = strings.sparkSession
    raw = stage(strings.select(F.col(column).alias("raw")).where("raw is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    plain = F.col("raw").rlike(_PLAIN)
    points = raw.where(~plain).select("id", F.posexplode(F.split("raw", "")).alias("i", "ch"))
    parts = points.join(F.broadcast(_parts_table(spark)), "ch", "left").select(
        "id", "i", F.posexplode(F.coalesce("parts", F.array(F.struct(F.col("ch").alias("o"), F.lit(0).alias("cls"), F.col("ch").alias("look"))))).alias("j", "p")
    ).select("id", "i", "j", "p.*")
    by_place = W.partitionBy("id").orderBy("i", "j")
    after_og = (F.col("o") == glyphs.TUTUQ) & F.lag("look").over(by_place).isin(*"oOgG")
    letter = F.col("o").rlike(r"^[\p{L}\p{M}ʻʼ]$")
    parts = parts.select(
        "id", "i", "j", "cls", letter.alias("letter"),
        F.when(after_og, glyphs.TURNED_COMMA).otherwise(F.col("o")).alias("o"),
        F.when(after_og, glyphs.TURNED_COMMA).otherwise(F.col("look")).alias("look"),
        F.sum((F.col("cls") == 0).cast("int")).over(by_place).alias("start"),
        F.sum((~letter).cast("int")).over(by_place).alias("run"),
    )
    by_run = W.partitionBy("id", "run")
    cyrillic = F.col("o").between("Ѐ", "ԯ") & ~F.col("o").isin(*glyphs.CYRILLIC_LOOKALIKES)
    latin = F.col("letter") & (F.col("cls") == 0) & ~F.col("o").between("Ͱ", "ԯ") & ~F.col("o").isin(*glyphs.LATIN_LOOKALIKES, glyphs.TURNED_COMMA, glyphs.TUTUQ)
    margin = F.sum(F.when(cyrillic, 1).when(latin, -1).otherwise(0)).over(by_run)
    to_cyrillic = F.create_map(*[F.lit(x) for pair in glyphs.TO_CYRILLIC.items() for x in pair])
    own = F.when((margin > 0) & F.col("letter"), F.coalesce(F.try_element_at(to_cyrillic, F.col("look")), F.col("look"))).otherwise(F.col("look"))
    parts = parts.select("id", "i", "j", "cls", "start", own.alias("o"), "look")
    cluster = F.array_sort(F.collect_list(F.struct("cls", "i", "j", "o", "look")))
    clusters = parts.groupBy("id", "start").agg(cluster.alias("marks"))
    one = lambda c: _composed(F.transform("marks", lambda m: F.struct(m[c].alias("c"), m["cls"].alias("cls"))))
    clusters = clusters.select("id", "start", one("o").alias("o"), one("look").alias("look"))
    rebuilt = F.array_sort(F.collect_list(F.struct("start", "o", "look")))
    joined = lambda c: _syllables(F.array_join(F.transform("clusters", lambda s: s[c]), ""))
    done = clusters.groupBy("id").agg(rebuilt.alias("clusters")).select("id", joined("o").alias("canon"), joined("look").alias("look"))
    other = raw.where(~plain).join(done, "id", "left").select("raw", F.coalesce("canon", F.lit("")).alias("canon"), F.coalesce("look", F.lit("")).alias("look"))
    return raw.where(plain).select("raw", F.col("raw").alias("canon"), F.col("raw").alias("look")).unionByName(other)


def words_and_heads(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project, pos, idx, raw) of the words without edge punctuation, and of the heading blocks' whole texts."""
    words = pages.select("project", "pos", F.posexplode("words.t").alias("idx", "t")).select("project", "pos", "idx", strip_edges(F.col("t")).alias("raw"))
    heads = pages.select("project", "pos", F.posexplode("blocks").alias("idx", "k")).where(F.col("k.type").isin("HEADING1", "HEADING2")).select("project", "pos", "idx", block_text(F.col("k.spans")).alias("raw"))
    return words, heads


def same_look(pages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words and headings that look like a ``lexicon`` term of their kind but are another string.

    Null words, blocks, spans or texts give no rows; repeated pages count once; a text that looks like several
    terms gives one row for each; if a term's own string is among them the text is no case of that term only.
    """
    words, heads = words_and_heads(pages)
    texts = words.select(F.lit("word").alias("kind"), "raw").distinct().unionByName(heads.select(F.lit("head").alias("kind"), "raw").distinct())
    texts = stage(texts)
    terms = lexicon.where("term is not null").select("term_id", "term", "kind")
    forms = stage(canonical(texts.select("raw").union(terms.select("term")), "raw").select("raw", "look"))
    wanted = small(terms.join(forms, terms["term"] == forms["raw"]).select("term_id", "term", "kind", "look"))
    cases = texts.join(forms, "raw").join(wanted, ["kind", "look"]).where("raw <> term").select("kind", "raw", "term_id")
    cases = small(cases)
    rows = words.join(cases.where("kind = 'word'"), "raw").select("project", "pos", F.lit("word").alias("place"), "idx", "term_id").unionByName(
        heads.join(cases.where("kind = 'head'"), "raw").select("project", "pos", F.lit("block").alias("place"), "idx", "term_id")
    )
    return rows.distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look(table(spark, sf_dir, "ocr_page"), table(spark, sf_dir, "lexicon"))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every distinct word and block text of ``ocr_page``."""
    pages = table(spark, sf_dir, "ocr_page")
    words = pages.select(F.explode("words.t").alias("raw"))
    blocks = pages.select(F.explode("blocks").alias("k")).select(block_text(F.col("k.spans")).alias("raw"))
    return canonical(words.union(blocks), "raw")
