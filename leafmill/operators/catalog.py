"""Catalogue of documents: change logs, listings, searches and page lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Extensions of the categories of a listing.
CATEGORIES = {
    "word": ("doc", "docx", "docm", "dotx", "rtf", "odt", "txt"),
    "excel": ("xls", "xlsx", "xlsm", "csv", "ods"),
    "ppt": ("ppt", "pptx", "ppsx", "pps", "odp"),
    "pdf": ("pdf",),
    "images": ("jpg", "jpeg", "png", "webp", "bmp", "gif", "heic"),
}
RECENTS = 200


def extension(name: Column) -> Column:
    """What follows the last point, in small letters; '' if there is none."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by ``order`` descending: the table that a change log amounts to (2.10)."""
    by = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def recents(opened: DataFrame) -> DataFrame:
    """The last opening of each file, favourites kept if any row of the file is one, the 200 latest; those never opened at the end."""
    fav = F.max(F.coalesce("fav", F.lit(False)))
    one = opened.where("uri is not null").groupBy("uri").agg(F.max_by(F.struct("name", "size"), F.struct("time", "name", "size")).alias("n"), F.max("time").alias("time"), fav.alias("fav"))
    return one.select("uri", "n.name", "n.size", "time", "fav").orderBy(F.col("time").desc_nulls_last(), "uri").limit(RECENTS)


def toggle(rows: DataFrame, key: str, value: str, column: str) -> DataFrame:
    """A flag turned over in the row of one key."""
    return rows.withColumn(column, F.when(F.col(key) == value, ~F.col(column)).otherwise(F.col(column)))


def home(recent: DataFrame, files: DataFrame) -> DataFrame:
    """Opened files, then the app's own, each address once (the first wins), latest first."""
    both = recent.where("time > 0").select("uri", "name", "time", "size", "fav", F.lit(0).alias("src")).unionByName(files.select("uri", "name", "time", "size", F.lit(False).alias("fav"), F.lit(1).alias("src")))
    one = latest(both, ["uri"], [F.col("src"), F.col("time").desc(), F.col("name")])
    return one.select("uri", "name", "time", "size", "fav").orderBy(F.col("time").desc(), "uri")


def in_category(name: Column, category: str) -> Column:
    """``other`` is every extension that no category knows; ``all`` is everything."""
    ext = extension(name)
    if category == "all":
        return F.lit(True)
    if category == "other":
        return ~ext.isin(*sorted({e for c in CATEGORIES.values() for e in c}))
    return ext.isin(*CATEGORIES[category])


def search(rows: DataFrame, column: str, query: str, least: int = 0) -> DataFrame:
    """Rows whose text contains the query in any case; a query shorter than ``least`` finds nothing."""
    q = query.strip().lower()
    if len(q) < least:
        return rows.where("false")
    return rows if not q else rows.where(F.contains(F.lower(F.col(column)), F.lit(q)))


def file_order(by: str = "name") -> list[Column]:
    """P5: folders first, then by name, or by time or size from the greatest."""
    rest = {"name": F.lower("name").asc(), "date": F.col("time").desc(), "size": F.col("size").desc()}[by]
    return [F.col("is_dir").desc(), rest, F.col("uri").asc()]


def to_do(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages that are not done."""
    return pages.join(done, ["project", "pos"], "left_anti")


def without_ids(projects: DataFrame, ids: list[str]) -> DataFrame:
    """Pages of these ids deleted."""
    return projects.withColumn("pages", F.filter("pages", lambda p: ~p["id"].isin(*ids)))


def move(pages: Column, at: int, by: int) -> Column:
    """P10: the element at ``at`` moved by ``by`` places, within the list."""
    to = F.greatest(F.lit(0), F.least(F.lit(at + by), F.size(pages) - 1))
    rest = F.filter(pages, lambda p, i: i != at)
    moved = F.concat(F.slice(rest, F.lit(1), to), F.slice(pages, at + 1, 1), F.slice(rest, to + 1, F.size(pages)))
    return F.when((F.size(pages) > at), moved).otherwise(pages)


def reset(pages: Column, ids: list[str]) -> Column:
    """These pages are to be recognised again: not done, confidence unknown, one revision more."""
    return F.transform(
        pages,
        lambda p: F.when(
            p["id"].isin(*ids),
            F.struct(p["id"].alias("id"), F.lit(False).alias("ocrDone"), F.lit(-1).alias("confidence"), (p["revision"] + 1).alias("revision")),
        ).otherwise(F.struct(p["id"].alias("id"), p["ocrDone"].alias("ocrDone"), p["confidence"].alias("confidence"), p["revision"].alias("revision"))),
    )


def rebuild(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Pages taken in the order of ``plan`` (doc, src, ord, turn): indexes out of range fall away, turns add up modulo 360."""
    return pages.join(plan, (pages["doc"] == plan["doc"]) & (pages["pos"] == plan["src"])).select(pages["doc"], plan["ord"].alias("pos"), F.pmod(F.col("rotation") + F.col("turn"), F.lit(360)).alias("rotation"))


def concatenated(documents: DataFrame) -> DataFrame:
    """Pages of several documents in order of (doc_ord, pos), numbered anew: offsets come from the page counts, one row for each of the few documents."""
    sizes = documents.groupBy("doc_ord").agg(F.count("*").alias("n"))
    offsets = sizes.select("doc_ord", (F.sum("n").over(W.orderBy("doc_ord")) - F.col("n")).alias("offset"))
    return documents.join(offsets, "doc_ord").withColumn("page", F.col("offset") + F.col("pos")).drop("offset")


def first_seen(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct values in the order of their first appearance."""
    return rows.groupBy(key).agg(F.min(pos).alias("first")).orderBy("first", key)


def sample_text(pages: DataFrame, pages_least: int = 3) -> DataFrame:
    """The text of each project's first pages, enough to tell its language."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n")
    return pages.where(F.col("pos") < pages_least).groupBy("project").agg(texts.alias("text"))


def renamed(title: Column, new: Column) -> Column:
    """P20: a blank title keeps the old one."""
    return F.when(F.trim(F.coalesce(new, F.lit(""))) != "", F.trim(new)).otherwise(title)


def progress(projects: DataFrame) -> DataFrame:
    """Pages done, pages, and the share in whole percent."""
    done = F.size(F.filter("pages", lambda p: p["ocrDone"]))
    n = F.greatest(F.size("pages"), F.lit(0))
    return projects.select("id", done.alias("done"), n.alias("total"), F.when(n > 0, (done * 100 / n).cast("int")).otherwise(0).alias("percent"))


def directory_sizes(files: DataFrame) -> DataFrame:
    """Bytes below every folder, at any depth: each file counts once for each of its folders."""
    parts = F.split(F.col("path"), "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(parents).alias("dir"), "size").groupBy("dir").agg(F.sum("size").alias("size"))


def unique_names(wanted: DataFrame) -> DataFrame:
    """K8: ``name`` or ``base (n).ext`` for repeated names, in the order of ``ord``."""
    n = F.row_number().over(W.partitionBy("name").orderBy("ord")) - 1
    base = F.when(F.col("name").contains("."), F.expr("substring(name, 1, length(name) - length(substring_index(name, '.', -1)) - 1)")).otherwise(F.col("name"))
    tail = F.when(F.col("name").contains("."), F.concat(F.lit("."), F.substring_index("name", ".", -1))).otherwise("")
    return wanted.select("ord", "name", F.when(n == 0, F.col("name")).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"), tail)).alias("unique"))


def safe_name(name: Column) -> Column:
    """K8: a file name without reserved signs and control characters, at most 80 characters; ``kitob`` if nothing is left."""
    out = F.trim(F.substring(F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "")), 1, 80))
    return F.when(out == "", "kitob").otherwise(out)


def newest_first(rows: DataFrame, time: str, tie: str) -> DataFrame:
    """Listings with the latest first."""
    return rows.orderBy(F.col(time).desc_nulls_last(), F.col(tie))


def targets(own: Column, without: Column) -> Column:
    """Formats that a document can be turned into, in their order, without some."""
    return F.array_except(own, without)


def one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row of one key."""
    return rows.where(F.col(key) == value)


def folders(log: DataFrame) -> DataFrame:
    """Saved folders out of a log of (uri, name, time, removed): the latest entry of each holds, later ones stand further down."""
    last = log.where("uri is not null").groupBy("uri").agg(F.max_by(F.struct("name", "removed"), F.struct("time", "name")).alias("n"), F.max("time").alias("time"))
    return last.where(~F.coalesce(F.col("n.removed"), F.lit(False))).select("uri", "n.name", "time").orderBy("time", "uri")


def rotate(pages: Column, ids: list[str], turn: int) -> Column:
    """Rotation of the selected pages (id, rotation), modulo 360."""
    return F.transform(pages, lambda p: F.struct(p["id"].alias("id"), F.when(p["id"].isin(*ids), F.pmod(p["rotation"] + turn, F.lit(360))).otherwise(p["rotation"]).alias("rotation")))


def keep(pages: Column, ids: list[str]) -> Column:
    """The selected pages alone."""
    return F.filter(pages, lambda p: p["id"].isin(*ids))


def drop(pages: Column, ids: list[str]) -> Column:
    """The selected pages deleted, unless these are all."""
    left = F.filter(pages, lambda p: ~p["id"].isin(*ids))
    return F.when(F.size(left) > 0, left).otherwise(pages)


def shift_selected(pages: Column, ids: list[str], later: bool = False) -> Column:
    """The selected pages one place earlier (or later), as a block: those at the edge stay, and so do those that follow them directly.

    A fold over the list: a selected page changes places with an unselected one before it.
    """
    chosen = lambda p: p["id"].isin(*ids)
    order = F.reverse(pages) if later else pages
    rest = F.slice(order, F.lit(2), F.greatest(F.size(order) - 1, F.lit(0)))

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        swap = chosen(p) & ~chosen(last)
        return F.when(swap, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(p), F.array(last))).otherwise(F.concat(done, F.array(p)))

    out = F.aggregate(rest, F.slice(order, F.lit(1), F.lit(1)), step)
    return F.when(F.size(pages) > 1, F.reverse(out) if later else out).otherwise(pages)


def with_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages that have an image, with its path."""
    return pages.join(images, "id", "left_semi").join(images, "id", "left")


def title_of(name: Column) -> Column:
    """a file's name without its extension."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


# Media types of what is exported.
MEDIA = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "html": "text/html", "csv": "text/csv", "jpg": "image/jpeg", "png": "image/png", "zip": "application/zip",
}


def media_type(name: Column) -> Column:
    """the media type of an exported file; unknown ones as bytes."""
    known = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit("application/octet-stream"))
