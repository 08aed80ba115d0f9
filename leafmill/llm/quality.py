"""Problem 2: page statistics that tell prose from lists, tables and junk.

Per language and statistic, exact ranks come from one range-partitioned sort: equal values are
counted first (so a value that most pages share is one row), the sorted partitions are ranked locally
and shifted by the sizes of the partitions before them. Ranks give empirical tail probabilities, and the
weighted sums of their negative logarithms are outlier scores for each kind of page. A page is of a kind if its score
reaches the bound of its language: the score of a page that is half of that kind and in no other statistic out of the ordinary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.boilerplate import page_counts, repeated_templates
from leafmill.llm.pagelines import common_keys, page_lines
from leafmill.plans.staging import range_partitions, small, stage, table

STATISTICS = ("list_lines", "table_lines", "junk_lines", "symbols", "word_length", "ended", "common", "line_words")
# The tail (1 upper, -1 lower) of each statistic in which pages of a kind lie.
TAILS = {
    "list": {"list_lines": 1, "ended": -1, "common": -1, "line_words": -1},
    "table": {"table_lines": 1, "symbols": 1, "common": -1, "word_length": -1},
    "junk": {"junk_lines": 1, "symbols": 1, "common": -1, "word_length": -1},
}
#: Weights of a kind's own statistic and of each general one, which the three kinds share.
OWN_WEIGHT, GENERAL_WEIGHT = 1.0, 0.01
#: A general statistic adds to a score beyond this tail of its language.
GENERAL_TAIL = 0.1
#: Share of lines of a kind of the page that sets the bound.
BOUNDARY = 0.5
#: Staged bytes of one range partition of the ranks.
_RANGE_BYTES = 64_000_000


def main_language(label) -> Column:
    """First language of a label such as ``uzb+eng``; ``und`` where it names none."""
    first = F.lower(F.trim(F.substring_index(F.coalesce(label, F.lit("")), "+", 1)))
    return F.when(first.isin("uzb", "uzb_cyrl", "rus", "eng"), first).otherwise("und")


def page_statistics(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row per page with text: ``STATISTICS`` over its lines, without lines of ``repeated`` templates and page numbers.

    The shares are those of a page however often its lines are repeated in ``lines``; ``lines`` and ``words`` count them all. A
    page whose lines are all left out gives no row.
    """
    own = lines.where("kind <> 'page'").join(repeated, "path", "left_anti")
    # sums over one count, not averages: a buffer less for each
    share = lambda c: F.sum(c.cast("int")) / F.count("*")
    return own.groupBy("project", "pos").agg(
        F.count("*").alias("lines"), F.sum("nw").alias("words"),
        *(share(F.col("kind") == k).alias(f"{k}_lines") for k in ("list", "table", "junk")),
        (F.sum("symbols") / F.greatest(F.sum("chars"), F.lit(1))).alias("symbols"), (F.sum("letters") / F.greatest(F.sum("nw"), F.lit(1))).alias("word_length"),
        share(F.col("ended")).alias("ended"), (F.sum("common") / F.greatest(F.sum("nw"), F.lit(1))).alias("common"), (F.sum("nw") / F.count("*")).alias("line_words"),
    )


def exact_ranks(values: DataFrame) -> DataFrame:
    """(grp, stat, value, below, upto, n) for every distinct value of ``values`` (grp, stat, value).

    ``below`` and ``upto`` count the values of the group's statistic that are smaller, and not greater; ``n`` counts all.
    Nulls and NaN are left out; ties share one row; empty input gives no rows. As many ranges are sorted as the counted values need.
    """
    counted = stage(values.where("value is not null and not isnan(value)").groupBy("grp", "stat", "value").agg(F.count("*").alias("k")))
    at = stage(counted.repartitionByRange(range_partitions(counted, _RANGE_BYTES), "grp", "stat", "value").withColumn("part", F.spark_partition_id()))
    sizes = at.groupBy("grp", "stat", "part").agg(F.sum("k").alias("size"))
    before = W.partitionBy("grp", "stat").orderBy("part")
    offsets = sizes.select("grp", "stat", "part", (F.sum("size").over(before) - F.col("size")).alias("offset"), F.sum("size").over(W.partitionBy("grp", "stat")).alias("n"))
    local = F.sum("k").over(W.partitionBy("grp", "stat", "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    ranked = at.withColumn("upto", local).join(small(offsets), ["grp", "stat", "part"])
    return ranked.select("grp", "stat", "value", (F.col("offset") + F.col("upto") - F.col("k")).alias("below"), (F.col("offset") + F.col("upto")).alias("upto"), "n")


def outlier_scores(statistics: DataFrame) -> DataFrame:
    """``statistics`` (project, pos, grp and ``STATISTICS``) with, for each kind, ``_score`` and the language's ``_bound``.

    A score is the weighted sum of the negative log tail probabilities of the kind's ``TAILS``. Of the general statistics only what
    lies beyond ``GENERAL_TAIL`` counts, so that an ordinary page has 0 there. The bound is null in a language
    that has no page with more than half of its lines of the kind.
    """
    long = statistics.select("project", "pos", "grp", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in STATISTICS])).alias("s")).select("project", "pos", "grp", "s.*")
    ranks = small(exact_ranks(long.select("grp", "stat", "value")))
    upper = -F.log((F.col("n") - F.col("below")) / F.col("n"))
    lower = -F.log(F.col("upto") / F.col("n"))

    def term(kind: str, stat: str, side: int) -> Column:
        tail = upper if side > 0 else lower
        return OWN_WEIGHT * tail if stat == f"{kind}_lines" else GENERAL_WEIGHT * F.greatest(tail + math.log(GENERAL_TAIL), F.lit(0.0))

    score = lambda kind: F.sum(F.coalesce(*[F.when(F.col("stat") == s, term(kind, s, side)) for s, side in TAILS[kind].items()], F.lit(0.0)))
    scores = long.join(ranks, ["grp", "stat", "value"]).groupBy("project", "pos").agg(*[score(kind).alias(f"{kind}_score") for kind in TAILS])
    more = F.col("n") - F.coalesce(F.max(F.when(F.col("value") <= BOUNDARY, F.col("upto"))), F.lit(0))
    above = ranks.where(F.col("stat").isin(*[f"{k}_lines" for k in TAILS])).groupBy("grp", "stat", "n").agg(more.alias("above")).where("above > 0")
    bound = lambda kind: F.max(F.when(F.col("stat") == f"{kind}_lines", -OWN_WEIGHT * F.log(F.col("above") / F.col("n")))).alias(f"{kind}_bound")
    bounds = small(above.groupBy("grp").agg(*map(bound, TAILS)))
    return statistics.join(scores, ["project", "pos"]).join(bounds, "grp", "left")


def page_labels(pages: DataFrame) -> DataFrame:
    """One row per page: (project, pos, grp, copies), the language that its label names and the number of its rows."""
    return pages.groupBy("project", "pos", main_language(F.col("language")).alias("grp")).agg(F.count("*").alias("copies"))


def scored_pages(labels: DataFrame, lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Statistics and outlier scores of every page with text of its own; ``labels`` are those of ``page_labels``."""
    statistics = page_statistics(lines, repeated).join(labels, ["project", "pos"])
    return outlier_scores(stage(statistics.withColumns({c: (F.col(c) / F.col("copies")).cast("int") for c in ("lines", "words")}).drop("copies")))


def page_kinds(scored: DataFrame) -> DataFrame:
    """(project, pos, kind) of the pages whose outlier score reaches the bound of a kind; of several the one exceeded by most, of ties the last by name."""
    # logarithms of equal ratios may differ by their last bits
    over = [F.when(F.col(f"{k}_score") > F.col(f"{k}_bound") - 1e-9, F.struct((F.col(f"{k}_score") - F.col(f"{k}_bound")).alias("by"), F.lit(k).alias("kind"))) for k in TAILS]
    return scored.select("project", "pos", F.greatest(*over)["kind"].alias("kind")).where("kind is not null")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_kinds(p2_statistics(spark, sf_dir))


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "ocr_page")
    lines = stage(page_lines(pages, common_keys(table(spark, sf_dir, "common_words"))))
    labels = stage(page_labels(pages))
    repeated = small(repeated_templates(lines, page_counts(labels)))
    return scored_pages(labels, lines, repeated)
