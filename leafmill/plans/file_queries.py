"""Queries over files and texts that are made from the driver tables: written, read back, and compared with the rows they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import numbers as N
from leafmill.functions import text as X
from leafmill.operators import aggregates as A
from leafmill.operators import arrays as I
from leafmill.operators import catalog as C
from leafmill.operators import layout as D
from leafmill.operators import sheet as Q
from leafmill.plans.queries import query
from leafmill.plans.staging import table
from leafmill.sinks import writers as K
from leafmill.sources import formats as S
from leafmill.sources import readers as R


def _files(made: DataFrame) -> DataFrame:
    """Rows (name, content) as the reader of files gives them."""
    return made.select(F.col("name").alias("path"), "content").withColumn("fmt", S.detected("content", S.by_extension(F.col("path"))))


def _supplier_cells(spark, d) -> DataFrame:
    """Suppliers as workbooks, one for each nation: the key, the name and the balance of each in a row."""
    t = table(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("book"), (F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).alias("row"), "s_suppkey", "s_name", "s_acctbal")
    values = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_acctbal").cast("decimal(12,2)").cast("string"))
    return t.select("book", F.lit(0).alias("sheet"), F.lit("Suppliers").alias("sheet_name"), "row", F.posexplode(values).alias("col", "raw"))


_SUPPLIERS = "(select 'n' || s_nationkey as book, cast(row_number() over (partition by s_nationkey order by s_suppkey) - 1 as int) as r, s_suppkey, s_name, s_acctbal from supplier)"


@query(f"""
with s as {_SUPPLIERS}, c as (select book, r, 0 as col, cast(s_suppkey as varchar) as raw from s union all select book, r, 1, s_name from s union all select book, r, 2, rtrim(rtrim(cast(cast(s_acctbal as decimal(12, 2)) as varchar), '0'), '.') from s)
select book || '.xlsx' as book, 0 as sheet, 'Suppliers' as sheet_name, r as row, col, raw from c""")
def s7_xlsx_cells(spark, d):
    """Workbooks written and read back."""
    cells = R.read_cells(_files(K.to_xlsx(_supplier_cells(spark, d))))
    shown = F.when(F.col("col") == 2, F.regexp_replace(F.regexp_replace("raw", r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise(F.col("raw"))
    return cells.where("error is null").select("book", "sheet", "sheet_name", "row", "col", shown.alias("raw"))


@query(f"""
with s as {_SUPPLIERS}, c as (select book, r, 0 as col, cast(s_suppkey as varchar) as raw from s union all select book, r, 1, '"' || s_name || '"; ' || r from s)
select book || '.csv' as book, r as row, col, raw from c""")
def s4_csv_cells(spark, d):
    """Quoted separators and quotes in a file of separated values."""
    t = _supplier_cells(spark, d).where("col < 2").groupBy("book", "row").agg(F.max(F.when(F.col("col") == 0, F.col("raw"))).alias("k"), F.max(F.when(F.col("col") == 1, F.col("raw"))).alias("n"))
    line = F.concat("k", F.lit(';"""'), "n", F.lit('""; '), F.col("row").cast("string"), F.lit('"'))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda s: s["line"]), "\r\n")
    made = t.groupBy("book").agg(F.encode(text, "UTF-8").alias("content")).select(F.concat("book", F.lit(".csv")).alias("name"), "content")
    return R.read_cells(_files(made)).select("book", "row", "col", "raw")


_SAID = "regexp_replace(coalesce(array_to_string(list_transform(b.spans, lambda s: coalesce(s.text, '')), ''), ''), '[^\\p{L}\\p{N} ]', ' ', 'g')"


def _said(spark, d) -> DataFrame:
    """Headings and paragraphs of the books, of letters, digits and blanks, numbered anew; the style of each by its place."""
    t = table(spark, d, "ocr_page").select("project", "pos", F.posexplode("blocks").alias("idx", "k")).where("k.type <> 'IMAGE'")
    text = F.regexp_replace(F.concat_ws("", F.transform("k.spans", lambda s: s["text"])), r"[^\p{L}\p{N} ]", " ")
    return t.select("project", "pos", "idx", F.when(F.col("k.type").isin("HEADING1", "HEADING2"), F.col("k.type")).otherwise("PARAGRAPH").alias("type"), text.alias("text")).where("trim(text) <> ''").distinct()


_BOOKS = f"""(select project, type, text, cast(row_number() over (partition by project order by pos, idx) - 1 as int) as idx from (
  select distinct project, pos, i - 1 as idx, case when b.type in ('HEADING1', 'HEADING2') then b.type else 'PARAGRAPH' end as type, {_SAID} as text
  from (select project, pos, i, blocks[i] as b from (select project, pos, blocks, unnest(range(1, len(blocks) + 1)) as i from ocr_page)) where b.type <> 'IMAGE') where trim(text, ' ') <> '')"""


@query(f"select project || '.docx' as doc, idx, type, 'CENTER' as align, text from {_BOOKS}")
def s10_docx_blocks(spark, d):
    """The books as documents, written and read back."""
    b = _said(spark, d).withColumn("align", F.lit("CENTER")).withColumn("spans", F.array(F.struct("text", (F.col("idx") % 2 == 0).alias("bold"), F.lit(False).alias("italic"))))
    return R.read_blocks(_files(K.to_docx(b))).select("doc", "idx", "type", "align", F.concat_ws("", F.transform("spans", lambda s: s["text"])).alias("text"))


@query(f"""select project || '.html' as doc, idx, type, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from {_BOOKS}""")
def s21_html_blocks(spark, d):
    """The books as markup, read back."""
    tag = F.when(F.col("type") == "HEADING1", "h1").when(F.col("type") == "HEADING2", "h2").otherwise("p")
    one = F.concat(F.lit("<"), tag, F.lit(">"), X.escape_html(F.trim(F.regexp_replace("text", r"\s+", " "))), F.lit("</"), tag, F.lit(">"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx", one.alias("one")))), lambda s: s["one"]), "\n")
    page = F.concat(F.lit('<html><head><meta charset="utf-8"></head><body>'), body, F.lit("</body></html>"))
    made = _said(spark, d).groupBy("project").agg(F.encode(page, "UTF-8").alias("content")).select(F.concat("project", F.lit(".html")).alias("name"), "content")
    return R.read_blocks(_files(made)).select("doc", "idx", "type", F.concat_ws("", F.transform("spans", lambda s: s["text"])).alias("text"))


@query(f"""select project || '.rtf' as doc, idx, text from {_BOOKS}""")
def s17_rtf_paragraphs(spark, d):
    """The books as rich text with every letter beyond ASCII escaped, read back."""
    escaped = F.array_join(F.transform(F.split("text", ""), lambda c: F.when(c.rlike(r"^[ -~]?$"), c).otherwise(F.concat(F.lit("\\u"), N.utf16_units(c), F.lit("?")))), "")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx", escaped.alias("one")))), lambda s: s["one"]), "\\par ")
    made = _said(spark, d).groupBy("project").agg(F.encode(F.concat(F.lit(r"{\rtf1\ansi "), body, F.lit("}")), "UTF-8").alias("content")).select(F.concat("project", F.lit(".rtf")).alias("name"), "content")
    return R.read_blocks(_files(made)).select("doc", "idx", F.concat_ws("", F.transform("spans", lambda s: s["text"])).alias("text"))


@query("""
with w as (select distinct project, pos, words from ocr_page where words is not null and len(words) > 0), v as (select project, pos, i - 1 as k, regexp_replace(coalesce(words[i].t, ''), '[^\\p{L}\\p{N}]', '', 'g') as text, words[i].x as l, words[i].y as t, words[i].x + words[i].w as r, words[i].y + words[i].h as b from (select project, pos, words, unnest(range(1, len(words) + 1)) as i from w))
select project || '/' || pos as page, cast(row_number() over (partition by project, pos order by k) - 1 as int) as word, text, l, t, r, b from v where text <> ''""")
def s27_hocr_words(spark, d):
    """Recognised pages as hOCR, read back."""
    w = table(spark, d, "ocr_page").select("project", "pos", "words").distinct().select(F.concat_ws("/", "project", F.col("pos").cast("string")).alias("page"), F.posexplode("words").alias("k", "o"))
    box = F.concat_ws(" ", *[c.cast("string") for c in (F.col("o.x"), F.col("o.y"), F.col("o.x") + F.col("o.w"), F.col("o.y") + F.col("o.h"))])
    one = F.concat(F.lit('<span class="ocrx_word" title="bbox '), box, F.lit('; x_wconf 90">'), F.regexp_replace(F.coalesce("o.t", F.lit("")), r"[^\p{L}\p{N}]", ""), F.lit("</span>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", one.alias("one")))), lambda s: s["one"]), "")
    pages = w.groupBy("page").agg(F.concat(F.lit('<div><div class="ocr_carea"><p class="ocr_par"><span class="ocr_line">'), body, F.lit("</span></p></div></div>")).alias("hocr"))
    return R.read_hocr(pages, "page").select("page", "word", "text", "l", "t", "r", "b")


# ---------------------------------------------------------------- operators without a query before


@query("""
select c_custkey, case when c_custkey % 3 = 0 then '<b>&' || chr(128512) || 'é' when c_custkey % 3 = 1 then 'x' || chr(160) || '"y"' else '' end as text from customer""")
def f24_entities(spark, d):
    """named entities and numeric ones of the whole code space."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "&lt;b&gt;&amp;&#x1F600;&#233;").when(k % 3 == 1, "x&#160;&quot;y&quot;").otherwise("&#55296;&#1114112;")
    return table(spark, d, "customer").select("c_custkey", X.decode_entities(text).alias("text"))


@query("""
select c_custkey, '<p ' || case when c_custkey % 2 = 0 then '' else 'id="a"' end || '>' || c_name || 'in</p><a href="#">x</a>' as html from customer""")
def f22_sanitised(spark, d):
    """scripts, frames, event attributes and script addresses taken out of markup."""
    odd = F.when(F.col("c_custkey") % 2 == 0, "").otherwise('id="a"')
    html = F.concat(F.lit("<p "), odd, F.lit(" onclick='x()'>"), "c_name", F.lit("<script>let a = '<p>';</script><iframe src=y>in</iframe></p><meta name=z><a href=\"vbscript:q\">x</a>"))
    return table(spark, d, "customer").select("c_custkey", X.sanitise(html).alias("html"))


@query("select s_suppkey, s_suppkey * 1.0 as pt, s_suppkey * 72 / 2.54 as cm, s_suppkey * 72.0 as inch, s_suppkey * 0.75 as px, cast(null as double) as other from supplier")
def f42_lengths(spark, d):
    """F42."""
    k = F.col("s_suppkey").cast("string")
    of = lambda unit: X.length_in_points(F.concat(k, F.lit(unit)))
    return table(spark, d, "supplier").select("s_suppkey", of("pt").alias("pt"), of("cm").alias("cm"), of("in").alias("inch"), of("px").alias("px"), of("em").alias("other"))


@query("select p_partkey, cast(p_size - 1 as int) as row, cast(p_partkey % 26 as int) as col, p_partkey % 2 = 1 as none from part")
def q10_references(spark, d):
    """Q10: references with and without dollar signs; what is none gives null."""
    k, letter = F.col("p_partkey"), F.char((F.col("p_partkey") % 26 + 65).cast("int"))
    ref = N.cell_reference(F.concat(F.when(k % 3 == 0, "$").otherwise(""), letter, F.when(k % 5 == 0, "$").otherwise(""), F.col("p_size").cast("string")))
    none = N.cell_reference(F.when(k % 2 == 1, F.concat(letter, F.lit("0x"))).otherwise(F.concat(letter, F.lit("7"))))
    return table(spark, d, "part").select("p_partkey", ref["row"].alias("row"), ref["col"].alias("col"), none.isNull().alias("none"))


@query("select s_nationkey, 'SUM(' || 'A' || min(s_suppkey + 1) || ':' || 'A' || max(s_suppkey + 1) || ')' as formula from supplier group by s_nationkey")
def q21_auto_functions(spark, d):
    """Q21."""
    at = lambda f: F.concat(F.lit("A"), f(F.col("s_suppkey") + 1).cast("string"))
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(A.auto_function("sum", at(F.min), at(F.max)).alias("formula"))


@query("select 'Data' as old, o_orderkey, 'SUM(''New data''!A1:A' || o_orderkey || ')+Other!B2' as formula from orders")
def q13_renamed_sheets(spark, d):
    """Q13: references follow a sheet's new name."""
    f = F.concat(F.lit("SUM(Data!A1:A"), F.col("o_orderkey").cast("string"), F.lit(")+Other!B2"))
    return table(spark, d, "orders").select(F.lit("Data").alias("old"), "o_orderkey", Q.rename_sheet(f, "Data", "New data").alias("formula"))


@query("""
with f as (select distinct uri, size from files where size >= 0 and uri is not null), p as (select string_split(uri, '/') as p, size from f), e as (select array_to_string(p[1:i], '/') as dir, size from (select p, size, unnest(range(1, len(p))) as i from p))
select dir, cast(sum(size) as bigint) as size from e group by dir""")
def a16_directory_sizes(spark, d):
    """A16."""
    return C.directory_sizes(table(spark, d, "files").where("size >= 0 and uri is not null").select(F.col("uri").alias("path"), "size").distinct())


@query("""
with w as (select distinct project, pos, words, confidence from ocr_page where words is not null and confidence is not null), v as (select project || '/' || pos as page, o.b as par, len(regexp_extract_all(coalesce(o.t, ''), '\\p{L}')) as letters, confidence + len(coalesce(o.t, '')) % 7 as conf from (select project, pos, confidence, unnest(words) as o from w)),
p as (select page, par, sum(letters) as letters, avg(conf) as c, sum(conf) as s, count(*) as n from v group by page, par)
select page, sum(s) / cast(sum(n) as double) as confidence from p where not (letters < 3 or (letters < 8 and c < 70)) group by page""")
def a14_mean_confidence(spark, d):
    """Lines as paragraphs, without fragments."""
    w = table(spark, d, "ocr_page").where("words is not null and confidence is not null").select("project", "pos", "words", "confidence").distinct().select(F.concat_ws("/", "project", F.col("pos").cast("string")).alias("page"), "confidence", F.explode("words").alias("o"))
    words = w.select("page", F.col("o.b").alias("par"), F.coalesce("o.t", F.lit("")).alias("text"), (F.col("confidence") + F.length(F.coalesce("o.t", F.lit(""))) % 7).alias("conf"))
    return D.mean_confidence(words)


@query("select l_returnflag, v as quantile from (select l_returnflag, min(v) as v from (select *, sum(w) over (partition by l_returnflag order by v) as a, sum(w) over (partition by l_returnflag) as t from (select l_returnflag, l_quantity as v, sum(l_linenumber) as w from lineitem group by all)) where a >= 0.35 * t group by l_returnflag)")
def d5_quantile(spark, d):
    """The weighted quantile at 0.35."""
    return D.weighted_quantile(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber", 0.35)


@query("""
with w as (select l_orderkey as page, l_linenumber as i, case when l_quantity > 45 then null else l_quantity end as stroke, l_linenumber + 2 as letters from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) as k from lineitem) where k = 1),
v as (select page, stroke, sum(letters) as wt from w where stroke is not null group by all), r as (select *, sum(wt) over (partition by page order by stroke) as a, sum(wt) over (partition by page) as t from v), q as (select page, min(stroke) as q from r where a >= 0.35 * t group by page), e as (select page from w where stroke is not null group by page having count(*) >= 4)
select w.page, w.i, case when e.page is null then false when stroke is not null then stroke > q * (1.42 - 0.30 * 0.5) end as bold from w left join e on e.page = w.page left join q on q.page = w.page""")
def d12_bold_words(spark, d):
    """D12 over lines of orders as words."""
    by = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    one = table(spark, d, "lineitem").withColumn("k", F.row_number().over(by)).where("k = 1")
    words = one.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("i"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("stroke"), (F.col("l_linenumber") + 2).alias("letters"))
    return D.bold_words(words).select("page", "i", "bold")


@query("select s_suppkey, (77 * (s_suppkey % 256) + 150 * (s_suppkey * 7 % 256) + 29 * (s_suppkey * 13 % 256)) // 256 as luma, case when s_suppkey % 256 <= 20 then 0 when s_suppkey % 256 >= 200 then 255 else (s_suppkey % 256 - 20) * 255 // 180 end as stretched, case when s_suppkey % 256 < 60 then 0 else 255 end as black from supplier")
def i1_pixels(spark, d):
    """I1, I5."""
    k = F.col("s_suppkey")
    v = (k % 256).cast("int")
    return table(spark, d, "supplier").select("s_suppkey", I.luma(k % 256, k * 7 % 256, k * 13 % 256).alias("luma"), I.stretch(v, F.lit(20), F.lit(200)).alias("stretched"), I.binarise(v, F.lit(30)).alias("black"))


@query("select event_id, avg(value) over (partition by user_id order by event_id rows between 2 preceding and 2 following) as smooth from (select event_id, user_id, cast(floor(value) as double) as value from events)")
def i9_moving_average(spark, d):
    """The centred moving average of whole values."""
    e = table(spark, d, "events").select("event_id", "user_id", F.floor("value").cast("double").alias("value"))
    return I.moving_average(e, ["user_id"], "event_id", "value", 2).select("event_id", "smooth")


@query("""
with p as (select distinct project, pos, blocks from ocr_page), t as (select project || '/' || pos as doc, cast(0 as int) as pos, len(regexp_extract_all(array_to_string(list_transform(blocks, lambda b: array_to_string(list_transform(b.spans, lambda s: coalesce(s.text, '')), '')), ' '), '\\p{L}')) as n from p)
select doc, sum(n) > 80 as has_text from t group by doc""")
def s26_has_text(spark, d):
    """Whether a page has enough letters to need no recognition."""
    p = table(spark, d, "ocr_page").select("project", "pos", "blocks").distinct()
    text = F.array_join(F.transform("blocks", lambda k: F.concat_ws("", F.transform(k["spans"], lambda s: s["text"]))), " ")
    return R.has_text(p.select(F.concat_ws("/", "project", F.col("pos").cast("string")).alias("doc"), F.lit(0).alias("pos"), F.coalesce(text, F.lit("")).alias("text")))


@query("select o_orderkey, strftime(o_orderdate, '%d.%m.%Y') as shown, cast(round(o_totalprice * 100) as bigint) || '%' as percent from (select o_orderkey, o_orderdate, floor(o_totalprice) as o_totalprice from orders)")
def f18_displayed(spark, d):
    """Serials by a date format, numbers by a percent format."""
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("double")
    return table(spark, d, "orders").select("o_orderkey", N.display(serial, "dd.mm.yyyy").alias("shown"), N.display(F.floor("o_totalprice").cast("double"), "0%").alias("percent"))


@query("""
with b as (select doc_id, row_number() over (partition by source order by doc_id) - 1 as pos, source from documents where title is not null)
select source as doc, 0 as slide, list(d.title order by d.doc_id) as texts from documents d where trim(coalesce(d.title, ''), ' ') <> '' group by source""")
def q24_outline(spark, d):
    """Q24: the texts of a slide in order, titles of a source standing for them."""
    t = table(spark, d, "documents").select(F.col("source").alias("doc"), F.lit(0).alias("slide"), F.col("doc_id").alias("pos"), F.col("title").alias("text"))
    return Q.outline(t)
