"""Queries over the driver tables, each beside the SQL of the same result; ids are those of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import numbers as N
from leafmill.functions import text as X
from leafmill.operators import aggregates as A
from leafmill.operators import arrays as I
from leafmill.operators import catalog as C
from leafmill.operators import layout as D
from leafmill.operators import sheet as Q
from leafmill.plans.ranking import global_rank
from leafmill.plans.staging import table
from leafmill.sinks import writers as K
from leafmill.sources import formats as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL of its result."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_MONEY = "decimal(18,2)"
_TEXT_OF_BLOCK = "array_to_string(list_transform(b.spans, lambda s: coalesce(s.text, '')), '')"


# ---------------------------------------------------------------- formulas


@query("""
select l_returnflag, cast(coalesce(sum(case when l_quantity >= 10 then cast(l_extendedprice as decimal(18,2)) end), 0) as double) as sum_if,
       cast(count(*) filter (where l_shipdate is not null and l_linestatus = 'O') as bigint) as count_if, avg(case when l_quantity <> 5 then l_quantity end) as average_if
from lineitem group by l_returnflag""")
def a7_conditional_aggregates(spark, d):
    """SUMIF, COUNTIF and AVERAGEIF over lineitem as a sheet."""
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(
        A.sum_if(F.col("l_quantity"), ">=10", F.col("l_extendedprice").cast(_MONEY)).cast("double").alias("sum_if"),
        A.count_if(F.col("l_linestatus"), "=o", numeric=False).alias("count_if"), A.average_if(F.col("l_quantity"), "<>5", F.col("l_quantity")).alias("average_if"),
    )


@query("""
select l_linestatus, sum(l_quantity) as s, avg(l_quantity) as a, min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(l_quantity) as n,
       count(*) filter (where coalesce(l_returnflag, '') <> '') as filled, count(*) filter (where coalesce(l_returnflag, '') = '') as blank, bool_and(l_discount < 0.11) as every, bool_or(l_tax > 0.07) as anyone
from lineitem group by l_linestatus""")
def a1_range_aggregates(spark, d):
    """A1 to A6."""
    q, p, r = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        A.sheet_sum(q).alias("s"), A.sheet_average(q).alias("a"), A.sheet_min(p).alias("lo"), A.sheet_max(p).alias("hi"), A.count_numbers(q).alias("n"), A.count_filled(r).alias("filled"), A.count_blank(r).alias("blank"),
        A.all_true(F.col("l_discount") < 0.11).alias("every"), A.any_true(F.col("l_tax") > 0.07).alias("anyone"),
    )


@query("""
with v as (select l_orderkey, l_linenumber, l_extendedprice - 30000 as x from lineitem)
select l_orderkey, l_linenumber, floor(x * 10 + 0.5) / 10 as r, sign(x) * ceil(abs(x)) / 1.0 as up, sign(x) * floor(abs(x) * 10) / 10 as down, cast(floor(x) as double) as whole, x - 7.0 * floor(x / 7.0) as m, x + 7.0 * floor(x / -7.0) as m2 from v""")
def f4_rounding(spark, d):
    """F4 to F7."""
    x = F.col("l_extendedprice") - 30000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.round_half_up(x, 1).alias("r"), N.round_up(x).alias("up"), N.round_down(x, 1).alias("down"), F.floor(x).cast("double").alias("whole"), N.modulo(x, F.lit(7.0)).alias("m"), N.modulo(x, F.lit(-7.0)).alias("m2"))


@query("""
select c_custkey, substring(c_name, 1, 4) as l, right(c_name, 3) as r, substring(c_name, 3, 5) as m, trim(regexp_replace('  ' || c_name || '   x ', '\\s+', ' ', 'g')) as t, upper(c_mktsegment) as u, lower(c_name) as lo,
       cast(length(c_name) as int) as n, c_name || c_mktsegment as j from customer""")
def f8_texts(spark, d):
    """F8 to F12."""
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", N.left(c, F.lit(4)).alias("l"), N.right(c, F.lit(3)).alias("r"), N.mid(c, F.lit(3), F.lit(5)).alias("m"), N.squeeze(F.concat(F.lit("  "), c, F.lit("   x "))).alias("t"), F.upper("c_mktsegment").alias("u"), F.lower(c).alias("lo"), N.utf16_length(c).alias("n"), F.concat(c, "c_mktsegment").alias("j"))


@query("""
with v as (select s_suppkey, case when s_suppkey % 4 = 0 then replace(cast(s_suppkey as varchar) || '.5', '.', ',') when s_suppkey % 4 = 1 then cast(s_suppkey as varchar) || '%' when s_suppkey % 4 = 2 then 'no ' || s_suppkey else '1 ' || cast(s_suppkey as varchar) end as raw from supplier)
select s_suppkey, case when s_suppkey % 4 = 0 then s_suppkey + 0.5 when s_suppkey % 4 = 1 then cast(s_suppkey as double) / 100 when s_suppkey % 4 = 3 then cast('1' || cast(s_suppkey as varchar) as double) end as value,
       case when s_suppkey % 4 = 0 then s_suppkey + 0.5 when s_suppkey % 4 = 1 then cast(s_suppkey as double) / 100 when s_suppkey % 4 = 3 then cast('1' || cast(s_suppkey as varchar) as double) end as typed from v""")
def f15_number_texts(spark, d):
    """Decimal comma, percent and blanks."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(s, F.lit(",5"))).when(k % 4 == 1, F.concat(s, F.lit("%"))).when(k % 4 == 2, F.concat(F.lit("no "), s)).otherwise(F.concat(F.lit("1 "), s))
    return table(spark, d, "supplier").select("s_suppkey", N.parse_number(raw).alias("value"), N.typed_number(raw).alias("typed"))


@query("""
select o_orderkey, cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as double) as serial from orders""")
def q8_typed_dates(spark, d):
    """Q8: dates typed as day.month.year become serials."""
    return table(spark, d, "orders").select("o_orderkey", N.typed_number(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("serial"))


@query("""
select p_partkey, p_retailprice * p_size / 3 as cost, case when p_size > 25 then floor(p_retailprice + 0.5) else 0.0 end as rounded from part""")
def f13_row_formulas(spark, d):
    """formulas of one row compiled to Columns."""
    from leafmill.operators.formula import to_column

    t = table(spark, d, "part")
    cols = {"price": F.col("p_retailprice"), "size": F.col("p_size")}
    return t.select("p_partkey", to_column('COL("price")*COL("size")/3', cols).alias("cost"), to_column('IF(COL("size")>25,ROUND(COL("price"),0),0)', cols).alias("rounded"))


@query("""
with l as (select cast(l_orderkey as varchar) as book, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as int) as row, l_quantity * (1 - l_discount) as num from lineitem),
s as (select book, cast(max(row) + 1 as int) as row, list_reduce(list_prepend(cast(0 as double), list(num order by row)), lambda a, x: a + x) as num from l group by book)
select book, row, cast(2 as int) as col, 'num' as kind, num from (select * from l union all select * from s)""")
def f17_recalculate(spark, d):
    """Every order is a workbook: its lines as rows, a product per row, sums and a cycle."""
    from leafmill.operators.formula import recalculate

    from pyspark.sql import Window as W

    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = table(spark, d, "lineitem").withColumn("row", F.row_number().over(by) - 1)
    book = F.col("l_orderkey").cast("string").alias("book")
    base = lambda col, raw, formula: li.select(book, F.lit(0).alias("sheet"), F.lit("Lines").alias("sheet_name"), "row", F.lit(col).alias("col"), raw.alias("raw"), F.lit(None).cast("string").alias("kind"), formula.alias("formula"))
    none = F.lit(None).cast("string")
    at = (F.col("row") + 1).cast("string")
    cells = base(0, F.col("l_quantity").cast("string"), none).unionByName(base(1, F.col("l_discount").cast("string"), none)).unionByName(base(2, none, F.concat(F.lit("A"), at, F.lit("*(1-B"), at, F.lit(")"))))
    totals = li.groupBy(book).agg(F.max("row").alias("last")).select("book", F.lit(0).alias("sheet"), F.lit("Lines").alias("sheet_name"), (F.col("last") + 1).alias("row"), F.lit(2).alias("col"), none.alias("raw"), none.alias("kind"), F.concat(F.lit("SUM(C1:C"), (F.col("last") + 1).cast("string"), F.lit(")")).alias("formula"))
    return recalculate(cells.unionByName(totals)).select("book", "row", "col", "kind", "num")


# ---------------------------------------------------------------- sheets

_MIXED = "case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then coalesce(cast(n_chars as varchar), '') when doc_id % 5 = 2 then 'TRUE' else coalesce(title, '') end"


def _mixed(spark, d):
    k = F.col("doc_id")
    raw = F.when(k % 5 == 0, "").when(k % 5 == 1, F.col("n_chars").cast("string")).when(k % 5 == 2, "TRUE").otherwise(F.coalesce("title", F.lit("")))
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"))


def _sort_sql(way: str) -> str:
    return f"""
with v as (select doc_id, trim({_MIXED}) as t from documents), w as (select doc_id, t, case when t = 'TRUE' then 1.0 when t <> '' and regexp_full_match(t, '[+-]?[0-9]+') then cast(t as double) end as num from v)
select doc_id, cast(row_number() over (order by case when t = '' then 1 else 0 end, case when num is not null then 0 else 1 end {way}, num {way} nulls last, lower(case when num is null then t else '' end) {way}, doc_id) as int) as place from w"""


def _placed(spark, d, ascending):
    order = [*Q.sort_keys(F.col("raw"), ascending), F.col("doc_id").asc()]
    return global_rank(_mixed(spark, d), order).select("doc_id", "place")


@query(_sort_sql("asc"))
def q1_sort_ascending(spark, d):
    """Q1 over mixed numbers, texts, booleans and blanks."""
    return _placed(spark, d, True)


@query(_sort_sql("desc"))
def q1_sort_descending(spark, d):
    """Q1 descending: blanks stay last."""
    return _placed(spark, d, False)


@query("select doc_id, title from documents where doc_id < 1 or contains(lower(title), 'kitob')")
def q2_view_filter(spark, d):
    """Q2."""
    return Q.view_filter(table(spark, d, "documents").select("doc_id", "title"), "title", "Kitob", "doc_id")


@query("""
select o_orderkey, case o when 1 then 'status' when 2 then 'priority' else 'C' end as label, case o when 1 then o_orderstatus when 2 then o_orderpriority else cast(o_custkey as varchar) end as value from orders, (values (1), (2), (3)) as t(o)""")
def q5_cards(spark, d):
    """Q5: orders as cards; the third column has no header and takes its letter."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") + 1).cast("int").alias("row"), "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("c"))
    cell = lambda col, raw: o.select(F.lit("b").alias("book"), F.lit(0).alias("sheet"), "row", F.lit(col).alias("col"), F.col(raw).alias("raw"))
    heads = spark.createDataFrame([("b", 0, 0, 0, "status"), ("b", 0, 0, 1, "priority")], "book string, sheet int, row int, col int, raw string")
    out = Q.cards(heads.unionByName(cell(0, "o_orderstatus")).unionByName(cell(1, "o_orderpriority")).unionByName(cell(2, "c")))
    return out.select((F.col("row") - 1).cast("bigint").alias("o_orderkey"), "label", "value")


@query("select p_partkey, replace(p_name, 'a', '<a>') as text, cast(length(p_name) - length(replace(p_name, 'a', '')) as int) as n from part")
def q6_replace(spark, d):
    """Q6."""
    r = Q.replace_all(F.col("p_name"), "a", "<a>")
    return table(spark, d, "part").select("p_partkey", r["text"].alias("text"), r["count"].alias("n"))


@query(f"""
with v as (select doc_id, text, trim(regexp_replace(text, '{X.BLANK}+', ' ', 'g'), ' ') as c from documents where text is not null)
select doc_id, cast(len(list_filter(string_split(c, ' '), lambda w: w <> '')) as int) as words, cast(length(c) as int) as chars, cast(length(regexp_replace(text, '{X.BLANK}+', '', 'g')) as int) as letters, cast(len(list_filter(string_split(text, chr(10)), lambda p: regexp_replace(p, '{X.BLANK}+', '', 'g') <> '')) as int) as paragraphs from v""")
def q7_statistics(spark, d):
    """Q7."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.statistics(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("""
select n_nationkey, case when i < 26 then chr(65 + i) when i < 702 then chr(64 + i // 26) || chr(65 + i % 26) else chr(65 + (i - 702) // 676) || chr(65 + (i - 702) % 676 // 26) || chr(65 + (i - 702) % 26) end as name, i as back
from (select n_nationkey, cast(n_nationkey * 61 as int) as i from nation)""")
def q9_column_letters(spark, d):
    """Q9: column numbers to letters and back."""
    i = (F.col("n_nationkey") * 61).cast("int")
    return table(spark, d, "nation").select("n_nationkey", N.column_name(i).alias("name"), N.column_index(N.column_name(i)).alias("back"))


_NATION_CELLS = "select 'n' as book, 0 as sheet, cast(n_nationkey // 5 as int) as row, cast(n_nationkey % 5 as int) as col, case when n_nationkey % 3 = 0 then n_name end as raw from nation"


def _nation_cells(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.lit("n").alias("book"), F.lit(0).alias("sheet"), F.floor(k / 5).cast("int").alias("row"), (k % 5).cast("int").alias("col"), F.when(k % 3 == 0, F.col("n_name")).alias("raw"))


@query(f"""
with c as ({_NATION_CELLS}), m as (select max(row) as r, max(col) as k from c where coalesce(raw, '') <> '')
select cast(a.i as int) as row, cast(b.j as int) as col, coalesce(c.raw, '') as raw from m, range(0, 100) a(i), range(0, 100) b(j) left join c on c.row = a.i and c.col = b.j where a.i <= m.r and b.j <= m.k""")
def q11_dense(spark, d):
    """Q11, S36."""
    return Q.dense(_nation_cells(spark, d)).select("row", "col", "raw")


@query(f"""
with c as ({_NATION_CELLS}), e as (select cast(r_regionkey as int) as row, 7 as col, r_name as raw from region union all select cast(r_regionkey as int), 0, case when r_regionkey = 0 then null else 'new' end from region)
select coalesce(c.row, e.row) as row, coalesce(c.col, e.col) as col, case when e.row is not null then e.raw else c.raw end as raw from c full join e on c.row = e.row and c.col = e.col where (case when e.row is not null then e.raw else c.raw end) is not null""")
def q14_edits(spark, d):
    """Q14."""
    r = table(spark, d, "region")
    edit = lambda col, raw, ord_: r.select(F.lit("n").alias("book"), F.lit(0).alias("sheet"), F.col("r_regionkey").cast("int").alias("row"), F.lit(col).alias("col"), raw.alias("raw"), F.lit(ord_).alias("ord"))
    edits = edit(7, F.lit("first"), 0).unionByName(edit(7, F.col("r_name"), 1)).unionByName(edit(0, F.when(F.col("r_regionkey") != 0, "new"), 0))
    return Q.apply_edits(_nation_cells(spark, d), edits).select("row", "col", "raw")


@query("""
with r as (select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 as int) as row from orders)
select o_orderkey, case when row >= 15 then row - 5 else row end as row from r where row < 10 or row >= 15""")
def q4_delete_rows(spark, d):
    """Q4: rows 10 to 14 of a sheet deleted, the rest moved up."""
    o = global_rank(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey").asc()], "row").withColumn("row", F.col("row") - 1)
    return Q.shift(o, "row", 10, -5).select("o_orderkey", "row")


@query("""
select p_partkey, p_retailprice as old, p_retailprice + 1.0 as new from part where p_size > 25""")
def q22_changed_cells(spark, d):
    """Q22, F19."""
    t = table(spark, d, "part").select(F.lit("b").alias("book"), F.lit(0).alias("sheet"), F.col("p_partkey").alias("row"), F.lit(0).alias("col"), F.col("p_retailprice").alias("value"), "p_size")
    new = t.withColumn("value", F.col("value") + F.when(F.col("p_size") > 25, 1.0).otherwise(0.0))
    return Q.changed(t, new).select(F.col("row").alias("p_partkey"), "old", "new")


@query("""
select c_custkey, coalesce(n_name, cast(c_nationkey + 20 as varchar)) as raw from customer left join nation on n_nationkey = c_nationkey + 20""")
def j1_shared_strings(spark, d):
    """Nation names as shared strings; indexes beyond them keep the raw value."""
    cells = table(spark, d, "customer").select("c_custkey", F.lit("b").alias("book"), F.lit("s").alias("kind"), (F.col("c_nationkey") + 20).cast("string").alias("raw"))
    strings = table(spark, d, "nation").select(F.lit("b").alias("book"), F.col("n_nationkey").cast("int").alias("idx"), F.col("n_name").alias("string"))
    return Q.shared_strings(cells, strings).select("c_custkey", "raw")


_CELLS = "select 'b' as book, 0 as sheet, cast(o_orderkey as int) as row, cast(o_custkey % 8 as int) as col, o_totalprice as value from orders"
_RANGES = "select cast(s_suppkey as int) as id, 'b' as book, 0 as sheet, cast(s_suppkey * 37 as int) as r0, cast(s_suppkey * 37 + s_suppkey % 700 as int) as r1, cast(s_nationkey % 4 as int) as c0, cast(s_nationkey % 4 + 3 as int) as c1 from supplier"


def _cells(spark, d):
    return table(spark, d, "orders").select(F.lit("b").alias("book"), F.lit(0).alias("sheet"), F.col("o_orderkey").cast("int").alias("row"), (F.col("o_custkey") % 8).cast("int").alias("col"), F.col("o_totalprice").alias("value"))


def _ranges(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, d, "supplier").select(k.cast("int").alias("id"), F.lit("b").alias("book"), F.lit(0).alias("sheet"), (k * 37).cast("int").alias("r0"), (k * 37 + k % 700).cast("int").alias("r1"), (n % 4).cast("int").alias("c0"), (n % 4 + 3).cast("int").alias("c1"))


@query(f"with c as ({_CELLS}), r as ({_RANGES}) select r.id, count(*) as n, max(c.value) as top from r join c on c.row between r0 and r1 and c.col between c0 and c1 group by r.id")
def j7_range_values(spark, d):
    """J7."""
    return Q.range_values(_ranges(spark, d), _cells(spark, d)).groupBy("id").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query(f"with c as ({_CELLS}), r as ({_RANGES}) select c.row, c.col from c where not exists (select 1 from r where c.row between r0 and r1 and c.col between c0 and c1 and not (c.row = r0 and c.col = c0))")
def j8_uncovered_cells(spark, d):
    """J8."""
    return Q.uncovered(_cells(spark, d), _ranges(spark, d)).select("row", "col")


@query(f"with r as ({_RANGES}) select a.id, b.id as other from r a join r b on a.r0 <= b.r1 and a.r1 >= b.r0 and a.c0 <= b.c1 and a.c1 >= b.c0 and a.id < b.id")
def j9_overlapping_ranges(spark, d):
    """Stated pairs of conflicting ranges of one sheet."""
    r = _ranges(spark, d)
    return Q.overlapping(r, r)


@query("""
select p_partkey, cast(list_position(ds, list_min(ds)) - 1 as int) as i from (select p_partkey, [abs(100 - p_retailprice), abs(1200 - p_retailprice), abs(1400 - p_retailprice), abs(1900 - p_retailprice)] as ds from part)""")
def j11_nearest_column(spark, d):
    """J11."""
    starts = F.array(*map(F.lit, (100, 1200, 1400, 1900)))
    return table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x")).select("p_partkey", Q.nearest(None, starts).alias("i"))


_WORDS = "(select project, pos, cast(i - 1 as int) as i, words[i].t as t, words[i].x as x, words[i].w as w, words[i].b as b, words[i].s as s from (select project, pos, words, unnest(range(1, len(words) + 1)) as i from (select distinct project, pos, words from ocr_page)))"


def _words(spark, d):
    pages = table(spark, d, "ocr_page").select("project", "pos", F.posexplode("words").alias("i", "word")).select("project", "pos", "i", "word.t", "word.x", "word.w", "word.b", "word.s")
    return pages.distinct()


@query(f"""
with w as {_WORDS}, m as (select *, case when lag(b) over k is null or abs(lag(b) over k - b) > greatest(3, s // 2) then 1 else 0 end as new from w window k as (partition by project, pos order by b, x, i))
select project, pos, i, cast(sum(new) over (partition by project, pos order by b, x, i) - 1 as bigint) as line from m""")
def q16_word_rows(spark, d):
    """Q16: recognised words to printed lines."""
    return Q.word_rows(_words(spark, d)).select("project", "pos", "i", "line")


@query(f"""
with w as {_WORDS}, m as (select *, case when lag(b) over k is null or abs(lag(b) over k - b) > greatest(3, s // 2) then 1 else 0 end as new from w window k as (partition by project, pos order by b, x, i)),
r as (select *, sum(new) over (partition by project, pos order by b, x, i) - 1 as line from m), g as (select *, case when x - lag(x + w) over k > 1.3 * s then 1 else 0 end as cut from r window k as (partition by project, pos, line order by x, i)),
c as (select *, sum(cut) over (partition by project, pos, line order by x, i) as cell from g)
select project, pos, cast(line as bigint) as line, cast(cell as bigint) as cell, min(x) as x, string_agg(t, ' ' order by x, i, t) as text from c group by project, pos, line, cell""")
def q17_line_cells(spark, d):
    """Q17: printed lines to table cells."""
    return Q.line_cells(Q.word_rows(_words(spark, d)))


@query("select p_partkey, regexp_full_match(replace(replace(v, ' ', ''), ',', '.'), '-?[0-9]{1,12}([.][0-9]+)?') as is_number from (select p_partkey, case when p_partkey % 3 = 0 then '1 ' || p_size || ',5' when p_partkey % 3 = 1 then p_brand else cast(-p_size as varchar) end as v from part)")
def k3_number_cells(spark, d):
    """K3."""
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("1 "), F.col("p_size").cast("string"), F.lit(",5"))).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise((-F.col("p_size")).cast("string"))
    return table(spark, d, "part").select("p_partkey", Q.is_table_number(v).alias("is_number"))


# ---------------------------------------------------------------- texts

_TOKENS = "(select distinct unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) as w from documents where text is not null)"


def _tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.explode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("w")).distinct()


def _n(pattern: str, of: str = "w") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


@query(f"""
with t as (select w, {_n('[Ѐ-ӿ]')} as cy, {_n('[A-Za-z]')} as la, {_n(f'[{X.LATIN_TWINS}]')} as lt, {_n(f'[{X.CYRILLIC_TWINS}]')} as ct from {_TOKENS})
select w, case when cy = 0 or la = 0 then w when cy > la and lt = la then translate(w, '{X.LATIN_TWINS}', '{X.CYRILLIC_TWINS}') when cy <= la and ct = cy then translate(w, '{X.CYRILLIC_TWINS}', '{X.LATIN_TWINS}') else w end as fixed from t""")
def f26_fold_script(spark, d):
    """F26 over the distinct words of the documents, which mix scripts."""
    return _tokens(spark, d).select("w", X.fold_script(F.col("w")).alias("fixed"))


@query(f"""
with t as (select w, {_n('[Ѐ-ӿ]')} >= {_n('[A-Za-z]')} as cy, length(w) >= 3 and contains(w, '0') and {_n('[\\p{L}]')} >= greatest(2, length(w) - 2) as fits from {_TOKENS})
select w, case when fits then list_reduce(list_prepend('', list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 2))), lambda a, x: a || case
  when substr(x, 1, 1) = '0' and (regexp_matches(right(a, 1), '^\\p{{L}}$') or regexp_matches(substr(x, 2, 1), '^\\p{{L}}$')) then
    case when regexp_matches(right(a, 1), '^\\p{{Lu}}$') and (length(x) = 1 or regexp_matches(substr(x, 2, 1), '^\\p{{Lu}}$')) then case when cy then 'О' else 'O' end else case when cy then 'о' else 'o' end end
  else substr(x, 1, 1) end) else w end as fixed from t""")
def f27_zero_repair(spark, d):
    """F27 over the distinct words of the documents."""
    return _tokens(spark, d).select("w", X.zero_to_letter(F.col("w")).alias("fixed"))


@query(f"""select w, regexp_replace(regexp_replace(w, '([oOgG])[''‘’`ʼ´]', '\\1ʻ', 'g'), 'ʻ[''‘’`ʼ´ʻ"“]+', 'ʻ', 'g') as fixed from {_TOKENS}""")
def f28_apostrophes(spark, d):
    """F28."""
    return _tokens(spark, d).select("w", X.uzbek_apostrophe(F.col("w")).alias("fixed"))


@query(f"""
with w as (select distinct words.t as t, confidence as c from (select unnest(words) as words, coalesce(confidence, -1) as confidence from ocr_page)), v as (select t, c, length(trim(t)) as n, {_n('[\\p{L}\\p{N}]', 'trim(t)')} as a from w)
select t, c, case when n = 0 then true when a = 0 then (c < 40 and n > 2) or regexp_full_match(trim(t), '[|_~^=<>\\\\/*#@]+') when c < 45 and n <= 2 and not regexp_matches(t, '\\p{{N}}') then true
  when n = 1 and c < 75 and trim(t) not in ({", ".join(f"'{w}'" for w in X.SINGLE_WORDS)}) and not regexp_matches(t, '\\p{{N}}') then true when c < 25 and n <= 4 then true when c < 40 and a / n < 0.5 then true else false end as noise from v""")
def f29_noise(spark, d):
    """F29 over distinct (word, page confidence)."""
    w = table(spark, d, "ocr_page").select(F.explode("words.t").alias("t"), F.coalesce("confidence", F.lit(-1)).alias("c")).distinct()
    return w.select("t", "c", X.is_noise(F.col("t"), F.col("c")).alias("noise"))


@query(f"""
with t as (select w, {_n('[Ѐ-ӿ]')} as cy, {_n('[A-Za-z]')} as la from {_TOKENS}) select w, cy > 0 and la = 0 and cy <= 2 as stray from t""")
def f30_stray_script(spark, d):
    """F30 for a Latin book at full confidence."""
    return _tokens(spark, d).select("w", X.is_stray_script(F.col("w"), F.lit(90), False).alias("stray"))


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query(f"""
with c as (select doc_id, text, {_n('[Ѐ-ӿ]', 'text')} as cy, {_n('[A-Za-z]', 'text')} as la, {_n('[ўқғҳЎҚҒҲ]', 'text')} as uz, {_n('[щыЩЫ]', 'text')} as ru, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}''ʻʼ‘’]+'), lambda w: w <> '') as ws from documents where text is not null),
s as (select *, coalesce(list_sum(list_transform(ws, lambda w: (case when w in ({_in(X.UZBEK_WORDS)}) then 1 else 0 end) + (case when regexp_matches(w, '[og][''ʻ‘]') then 1 else 0 end) + (case when starts_with(w, 'sh') or starts_with(w, 'ch') or suffix(w, 'lar') or suffix(w, 'ning') then 1 else 0 end))), 0) as us,
  coalesce(list_sum(list_transform(ws, lambda w: (case when w in ({_in(X.ENGLISH_WORDS)}) then 1 else 0 end) + (case when (suffix(w, 'ing') and not suffix(w, 'ning')) or suffix(w, 'tion') or starts_with(w, 'th') then 1 else 0 end))), 0) as es from c)
select doc_id, case when cy + la < 60 then null when cy > la then (case when uz >= 3 and uz / cy > 0.004 and uz > ru then 'uzb_cyrl+rus' else 'rus+eng' end) when us >= es then 'uzb+eng' else 'eng' end as label from s""")
def f31_detect_language(spark, d):
    """F31 over whole documents."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.detect_language(F.col("text")).alias("label"))


_LINES = "(select distinct unnest(string_split(text, chr(10))) as l from documents where text is not null)"


def _lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("l")).distinct()


@query(f"""
select l, regexp_full_match(trim(l), '[\\s\\-–—.·•(\\[]*(\\d{{1,4}}|[IVXLCDM]{{1,7}}|[ivxlcdm]{{1,7}})[\\s\\-–—.·•)\\]]*') as page, regexp_matches(regexp_replace(l, '\\s+$', ''), '[.!?…]$|[.!?…][»"”)''’]$') as ends, regexp_matches(regexp_replace(l, '\\s+$', ''), '[.!?…]$|[.!?…][»"”)''’]$') or regexp_matches(regexp_replace(l, '\\s+$', ''), '[:»"”]$') as clause,
  regexp_matches(regexp_extract(l, '^[^\\p{{L}}]*(\\p{{L}})', 1), '^\\p{{Ll}}$') as starts from {_LINES}""")
def f32_line_tests(spark, d):
    """F32, F34 over the distinct lines of the documents."""
    l = F.col("l")
    return _lines(spark, d).select("l", X.is_page_number(l).alias("page"), X.ends_terminal(l).alias("ends"), X.ends_clause(l).alias("clause"), X.starts_lower(l).alias("starts"))


@query("""select doc_id, regexp_replace(text, '(\\p{L})[-‐‑¬' || chr(173) || '][ \\t]*\\n\\s*(\\p{Ll})', '\\1\\2', 'g') as text from documents where text is not null""")
def f35_dehyphenate(spark, d):
    """F35, first case."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.dehyphenate(F.col("text")).alias("text"))


@query("select doc_id, regexp_replace(lower(text), '[^\\p{L}]', '', 'g') as key from documents where text is not null")
def f38_keys(spark, d):
    """F38."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.key(F.col("text")).alias("key"))


@query("""
select uri, name, size, case when size is null or size < 0 then '—' when size < 1024 then printf('%d B', size) when size < 1048576 then printf('%d KB', size // 1024) when size < 1073741824 then printf('%.1f MB', size / 1048576.0) else printf('%.2f GB', size / 1073741824.0) end as shown,
  case when name is not null and contains(name, '.') then lower(list_extract(string_split(name, '.'), -1)) else '' end as ext from (select distinct uri, name, size from files)""")
def f40_file_labels(spark, d):
    """F40, F43."""
    return table(spark, d, "files").select("uri", "name", "size").distinct().select("uri", "name", "size", X.human_size(F.col("size")).alias("shown"), C.extension(F.col("name")).alias("ext"))


@query("""select doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as html, text as back, cast(length(text) - length(replace(text, ' ', '')) as int) as spaces from documents where text is not null""")
def f25_escape(spark, d):
    """escape and back."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.escape_html(t).alias("html"), X.decode_entities(X.escape_html(t)).alias("back"), X.space_count(t).alias("spaces"))


@query(f"""select project, pos, array_to_string(list_transform(list_filter(blocks, lambda b: b.type <> 'IMAGE'), lambda b: {_TEXT_OF_BLOCK}), chr(10) || chr(10)) as text from (select distinct project, pos, blocks from ocr_page)""")
def k1_plain_text(spark, d):
    """K1 over recognised pages."""
    return table(spark, d, "ocr_page").select("project", "pos", X.plain_text(F.col("blocks")).alias("text")).distinct()


# ---------------------------------------------------------------- layout


@query("""
with v as (select l_returnflag, l_quantity as v, sum(l_linenumber) as w from lineitem group by all), r as (select *, sum(w) over (partition by l_returnflag order by v) as a, sum(w) over (partition by l_returnflag) as t from v)
select l_returnflag, min(v) as quantile from r where a >= 0.5 * t group by l_returnflag""")
def d4_weighted_median(spark, d):
    """Quantities weighted by line number."""
    return D.weighted_quantile(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber")


@query("select l_returnflag, list_extract(list_sort(list(l_extendedprice)), cast(floor(cast(cast(count(*) - 1 as float) * cast(0.1 as float) as float)) as bigint) + 1) as percentile from lineitem group by l_returnflag")
def d6_percentile(spark, d):
    """D6."""
    return D.percentile(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.1)


@query(f"""
with l as (select project, pos, b, max(s) as size, count(*) as n from {_WORDS} group by project, pos, b) select project, pos, sum(size * n) / cast(sum(n) as double) as size from l group by project, pos""")
def d11_average_size(spark, d):
    """Mean line size of each page."""
    lines = _words(spark, d).groupBy("project", "pos", "b").agg(F.max("s").alias("size"), F.count("*").alias("words"))
    return D.average_size(lines, ["project", "pos"])


_BLOCKS = f"(select project, pos, cast(i - 1 as int) as idx, blocks[i].type as type, array_to_string(list_transform(blocks[i].spans, lambda s: coalesce(s.text, '')), '') as text from (select project, pos, blocks, unnest(range(1, len(blocks) + 1)) as i from (select distinct project, pos, blocks from ocr_page)))"


def _blocks(spark, d):
    t = table(spark, d, "ocr_page").select("project", "pos", F.posexplode("blocks").alias("idx", "k"))
    return t.select("project", "pos", "idx", F.col("k.type").alias("type"), F.concat_ws("", F.transform("k.spans", lambda s: s["text"])).alias("text")).distinct()


@query(f"""
with b as {_BLOCKS}, t as (select *, row_number() over (partition by project, pos order by idx) as d, row_number() over (partition by project, pos order by idx desc) as u from b where type <> 'IMAGE'),
k as (select distinct project, pos, regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g') as key from t where d <= 2 or u = 1), n as (select project, key, count(*) as pages from k where length(key) between 6 and 90 group by project, key), o as (select project, count(distinct pos) as c from b group by project)
select n.project, n.key, n.pages from n join o on o.project = n.project where n.pages >= 2 and n.pages >= 0.3 * o.c""")
def d16_running_heads(spark, d):
    """D16 by equal keys."""
    return D.running_heads(_blocks(spark, d))


# letters of several bytes as letters of one, as the SQL counts edits in bytes
_WIDE = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяўқғҳіјѕԁӏһöüçşğñáàâäéèêíóôúʻʼ"
_NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}"[: len(_WIDE)]
_WIDE += "".join(chr(0xFF41 + i) for i in range(26))
_NARROW += "".join(chr(1 + i) for i in range(26))


@query(f"""
with b as {_BLOCKS}, t as (select *, row_number() over (partition by project, pos order by idx) as d, row_number() over (partition by project, pos order by idx desc) as u, regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g') as k from b where type <> 'IMAGE'),
c as (select distinct project, pos, k as key from t where d <= 2 or u = 1), o as (select project, count(distinct pos) as c from b group by project), h as (select c.project, key from c join o on o.project = c.project where length(key) between 6 and 90 group by c.project, key, o.c having count(*) >= 2 and count(*) >= 0.3 * o.c),
m as (select t.project, t.pos, t.idx, min(h.key) as head from t join h on h.project = t.project and length(k) >= length(key) * 0.75 and levenshtein(translate(left(k, length(key)), '{_WIDE}', '{_NARROW}'), translate(key, '{_WIDE}', '{_NARROW}')) <= greatest(length(left(k, length(key))), length(key)) * 0.2 group by all)
select b.project, b.pos, b.idx, case when head is null then b.text else regexp_replace(regexp_replace(case when length(regexp_replace(b.text, '[^\\p{{L}}]', '', 'g')) < length(head) then '' else regexp_replace(b.text, '(?s)^([^\\p{{L}}]*\\p{{L}}){{' || length(head) || '}}', '') end, '^[^ \\t\\n\\x0B\\f\\r]+', ''), '^[ ,.;:—-]+', '') end as text
from b left join m on m.project = b.project and m.pos = b.pos and m.idx = b.idx where head is null or length(regexp_replace(lower(b.text), '[^\\p{{L}}]', '', 'g')) > length(head) * 1.3""")
def d17_without_heads(spark, d):
    """Blocks without running heads, by similar keys."""
    b = _blocks(spark, d)
    return D.without_heads(b, D.running_heads(b)).select("project", "pos", "idx", "text")


@query(f"""
with b as {_BLOCKS}, t as (select *, row_number() over (partition by project, pos order by idx) as d, row_number() over (partition by project, pos order by idx desc) as u from b where type <> 'IMAGE'),
e as (select f.project, f.pos, f.type, f.text, p.type as pt, regexp_replace(p.text, '\\s+$', '') as p from t f left join t p on p.project = f.project and p.pos = f.pos - 1 and p.u = 1 where f.d = 1)
select project, pos, type = 'PARAGRAPH' and coalesce(pt, '') = 'PARAGRAPH' and coalesce(case when length(p) * length(ltrim(text, ' ')) = 0 then false when regexp_matches(p, '[-‐‑¬' || chr(173) || ']$') then true when regexp_matches(p, '[.!?…]$|[.!?…][»"”]$') then false
  when regexp_matches(text, '\\p{{L}}') then regexp_matches(regexp_extract(text, '^[^\\p{{L}}]*(\\p{{L}})', 1), '^\\p{{Ll}}$') or suffix(p, ',') else false end, false) as goes from e""")
def d15_page_joins(spark, d):
    """Whether a page's first block goes on from the page before."""
    from pyspark.sql import Window as W

    b = _blocks(spark, d).where("type <> 'IMAGE'")
    t = b.withColumn("d", F.row_number().over(W.partitionBy("project", "pos").orderBy("idx"))).withColumn("u", F.row_number().over(W.partitionBy("project", "pos").orderBy(F.col("idx").desc())))
    prev = t.where("u = 1").select("project", (F.col("pos") + 1).alias("pos"), F.col("text").alias("prev"), F.col("type").alias("ptype"))
    both = t.where("d = 1").join(prev, ["project", "pos"], "left")
    goes = (F.col("type") == "PARAGRAPH") & (F.coalesce("ptype", F.lit("")) == "PARAGRAPH") & D.can_join(F.col("prev"), F.col("text"))
    return both.select("project", "pos", F.coalesce(goes, F.lit(False)).alias("goes"))


@query(f"""
with b as {_BLOCKS}, t as (select *, row_number() over (partition by project, pos order by idx) as d, row_number() over (partition by project, pos order by idx desc) as u from b where type <> 'IMAGE'),
e as (select f.*, case when f.d = 1 then p.type end as pt, case when f.d = 1 then regexp_replace(p.text, '\\s+$', '') end as p from t f left join t p on p.project = f.project and p.pos = f.pos - 1 and p.u = 1),
g as (select *, type = 'PARAGRAPH' and coalesce(pt, '') = 'PARAGRAPH' and coalesce(case when length(p) * length(ltrim(text, ' ')) = 0 then false when regexp_matches(p, '[-‐‑¬' || chr(173) || ']$') then true when regexp_matches(p, '[.!?…]$|[.!?…][»"”]$') then false
  when regexp_matches(text, '\\p{{L}}') then regexp_matches(regexp_extract(text, '^[^\\p{{L}}]*(\\p{{L}})', 1), '^\\p{{Ll}}$') or suffix(p, ',') else false end, false) as goes from e),
n as (select *, sum(case when goes then 0 else 1 end) over (partition by project order by pos, idx) as part from g)
select project, min(pos) as pos, arg_min(idx, (pos, idx)) as idx, arg_min(type, (pos, idx)) as type, list_reduce(list(text order by pos, idx), lambda a, x: case
  when regexp_matches(rtrim(a, ' '), '\\p{{L}}[-‐‑¬' || chr(173) || ']$') and regexp_matches(regexp_extract(ltrim(x, ' '), '^[^\\p{{L}}]*(\\p{{L}})', 1), '^\\p{{Ll}}$') then left(rtrim(a, ' '), length(rtrim(a, ' ')) - 1) || ltrim(x, ' ') else rtrim(a, ' ') || ' ' || ltrim(x, ' ') end) as text
from n group by project, part""")
def d15_assemble(spark, d):
    """Paragraphs over page edges."""
    return D.assemble(_blocks(spark, d))


@query(f"""
with b as {_BLOCKS}, h as (select project, pos, idx, case type when 'HEADING1' then 1 else 2 end as level, text as title from b where type in ('HEADING1', 'HEADING2')) select * from h where project in (select project from h group by project having count(*) >= 2)""")
def a11_contents(spark, d):
    """A11."""
    return D.contents(_blocks(spark, d))


@query("""
with l as (select doc_id, n, trim(line, ' ') as line from (select doc_id, generate_subscripts(p, 1) as n, unnest(p) as line from (select doc_id, string_split_regex(text, '\r\n|\r|\n') as p from documents where text is not null))),
m as (select *, coalesce(sum(case when line = '' or (length(line) < 45 and regexp_matches(line, '[.!?:]$')) then 1 else 0 end) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as par from l),
p as (select doc_id as doc, par, list_reduce(list(line order by n), lambda a, x: case when suffix(a, '-') and regexp_matches(x, '^\\p{Ll}') then left(a, length(a) - 1) || x else a || ' ' || x end) as text from m where line <> '' group by doc_id, par),
q as (select *, regexp_replace(text, '[^\\p{L}]', '', 'g') as k from p)
select doc, cast(par as bigint) as par, text, case when length(text) < 70 and not suffix(text, '.') and length(text) - length(replace(text, ' ', '')) < 10 and k <> '' and k = upper(k) then 'HEADING2' else 'PARAGRAPH' end as type from q""")
def f36_paragraphs(spark, d):
    """F36 over documents as pages."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.lit(0).alias("pos"), "text")
    return D.page_paragraphs(t).select("doc", "par", "type", "text")


@query("""
with p as (select distinct project, pos, list_transform(blocks, lambda b: list_transform(b.spans, lambda s: {'bold': s.bold, 'italic': s.italic, 'text': s.text})) as bs from ocr_page)
select project, pos, cast(coalesce(list_sum(list_transform(bs, lambda b: coalesce(list_sum(list_transform(range(1, len(b) + 1), lambda i: case when i = 1 or b[i].bold <> b[i - 1].bold or b[i].italic <> b[i - 1].italic then 1 else 0 end)), 0))), 0) as bigint) as spans from p""")
def d14_merged_spans(spark, d):
    """Number of spans of each page after neighbours of one style are merged."""
    n = F.aggregate(F.coalesce("blocks", F.array()), F.lit(0).cast("bigint"), lambda a, b: a + F.greatest(F.size(D.merge_spans(b["spans"])), F.lit(0)))
    return table(spark, d, "ocr_page").select("project", "pos", n.alias("spans")).distinct()


@query()
def d1_analyse_pages(spark, d):
    """Words of recognised pages to blocks; every printed line of one page is in one paragraph group."""
    from leafmill.operators.pagelayout import analyse_pages

    pages = table(spark, d, "ocr_page").where("size(words) > 0").select(F.concat_ws("/", "project", F.col("pos").cast("string")).alias("page_id"), F.struct("project", "pos", "width", "height", "confidence", "words").alias("page"))
    # one shuffle, of whole pages: repeated rows go, rows of one page come together and stay so
    whole = pages.groupBy("page_id").agg(F.sort_array(F.collect_set("page")).alias("pages")).select("page_id", F.explode("pages").alias("page")).select("page_id", "page.*")
    w = whole.select("page_id", "width", "height", F.coalesce("confidence", F.lit(-1)).alias("conf"), F.posexplode("words").alias("word", "o"))
    words = w.where("o.t is not null").select(
        "page_id", "width", "height", F.lit(0).alias("block"), F.lit(0).alias("par"), F.col("o.b").alias("line"), "word", F.col("o.t").alias("text"), F.col("o.x").alias("l"), F.col("o.y").alias("t"), (F.col("o.x") + F.col("o.w")).alias("r"),
        (F.col("o.y") + F.col("o.h")).alias("b"), F.when(F.col("conf") < 0, 60).otherwise(F.col("conf")).alias("conf"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.col("o.s").cast("double").alias("size"),
    )
    return analyse_pages(words, together=True).select("page_id", "idx", "type", "align", F.concat_ws("", F.transform("spans", lambda s: s["text"])).alias("text"))


@query("select source, title, string_agg(fmt, ',' order by doc_id) as fmts from documents where title is not null group by source, title")
def a13_groups(spark, d):
    """Items gathered by key, in order."""
    groups = A.gathered(table(spark, d, "documents").where("title is not null"), ["source", "title"], "doc_id", "fmt")
    return groups.select("source", "title", F.array_join("values", ",").alias("fmts"))


@query("select c_custkey, c_name, min(o_orderkey) as path from customer join orders on o_custkey = c_custkey group by all")
def j12_semi_join(spark, d):
    """Pages that have an image, customers with orders standing for them."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("path"))
    return C.with_images(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), orders).select(F.col("id").alias("c_custkey"), "c_name", "path")


@query(f"""
with l as (select doc_id, generate_subscripts(p, 1) as n, regexp_replace(unnest(p), '^{X.BLANK}+|{X.BLANK}+$', '', 'g') as line from (select doc_id, string_split_regex(text, '\r\n|\r|\n') as p from documents where text is not null)),
r as (select doc_id, cast(row_number() over (partition by doc_id order by n) - 1 as int) as row, string_split_regex(line, '\\s{{2,}}|\\t') as parts from l where line <> '')
select doc_id as book, row, cast(generate_subscripts(parts, 1) - 1 as int) as col, unnest(parts) as raw from r""")
def k12_text_cells(spark, d):
    """Lines as table cells."""
    pages = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.lit(0).alias("pos"), "text")
    return K.text_to_cells(pages).select("book", "row", "col", "raw")


# ---------------------------------------------------------------- catalogue


@query("""
with o as (select uri, arg_max({'name': name, 'size': size}, {'time': time, 'name': name, 'size': size}) as n, max(time) as time, bool_or(coalesce(fav, false)) as fav from files where uri is not null group by uri)
select uri, n.name as name, n.size as size, time, fav from o order by time desc nulls last, uri limit 200""")
def cat1_recent_files(spark, d):
    """The log of opened files as the list of recents (a list of 200 by its nature)."""
    return C.recents(table(spark, d, "files"))


@query("""
with v as (select distinct * from files where name is not null), c as (select *, case when contains(name, '.') then lower(list_extract(string_split(name, '.'), -1)) else '' end as e from v)
select uri, name, time, e in ('doc', 'docx', 'docm', 'dotx', 'rtf', 'odt', 'txt') as word, e not in ('doc', 'docx', 'docm', 'dotx', 'rtf', 'odt', 'txt', 'xls', 'xlsx', 'xlsm', 'csv', 'ods', 'ppt', 'pptx', 'ppsx', 'pps', 'odp', 'pdf', 'jpg', 'jpeg', 'png', 'webp', 'bmp', 'gif', 'heic') as other,
  case when e = 'pdf' then 'PDF' when e in ('docx', 'docm', 'dotx', 'dotm') then 'DOCX' when e in ('xlsx', 'xlsm', 'xltx', 'xltm') then 'XLSX' when e in ('pptx', 'pptm', 'ppsx', 'ppsm', 'potx', 'potm') then 'PPTX' when e in ('odt', 'ott') then 'ODT' when e in ('ods', 'ots') then 'ODS' when e in ('odp', 'otp') then 'ODP' when e = 'rtf' then 'RTF' when e in ('doc', 'dot') then 'DOC'
  when e in ('xls', 'xlt') then 'XLS' when e in ('ppt', 'pps', 'pot') then 'PPT' when e = 'epub' then 'EPUB' when e in ('html', 'htm', 'xhtml') then 'HTML' when e = 'csv' then 'CSV' when e in ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'gif', 'heic', 'heif') then 'IMAGE' when e in ('txt', 'md', 'log', 'json', 'xml', 'ini', 'kt', 'java', 'py', 'js', 'css', 'yaml', 'yml') then 'TXT' else 'UNKNOWN' end as fmt from c""")
def s1_file_kinds(spark, d):
    """S1, P4."""
    t = table(spark, d, "files").where("name is not null").distinct()
    n = F.col("name")
    return t.select("uri", "name", "time", C.in_category(n, "word").alias("word"), C.in_category(n, "other").alias("other"), S.by_extension(n).alias("fmt"))


@query("""
with b as (select uri, name, time, size, fav, 0 as src from files where time > 0 union all select 'doc' || doc_id, title, cast(epoch_us(saved_at) // 1000 as bigint), n_chars, false, 1 from documents where saved_at is not null),
r as (select *, row_number() over (partition by uri order by src, time desc, name nulls first, size nulls first, fav nulls first) as n from b) select uri, time, fav from r where n = 1""")
def cat3_home_list(spark, d):
    """Opened files and saved documents, each once."""
    recent = table(spark, d, "files")
    docs = table(spark, d, "documents").where("saved_at is not null").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("uri"), F.col("title").alias("name"), F.unix_millis("saved_at").alias("time"), F.col("n_chars").alias("size"))
    both = C.latest(recent.where("time > 0").select("uri", "name", "time", "size", "fav", F.lit(0).alias("src")).unionByName(docs.withColumns({"fav": F.lit(False), "src": F.lit(1)})), ["uri"], [F.col("src"), F.col("time").desc(), F.col("name").asc_nulls_first(), F.col("size").asc_nulls_first(), F.col("fav").asc_nulls_first()])
    return both.select("uri", "time", "fav")


@query("""
with f as (select uri, max(is_dir) as is_dir, max(lower(name)) as name, max(size) as size from files where uri is not null group by uri)
select uri, cast(row_number() over (order by is_dir desc, name nulls first, uri) as int) as place from f""")
def cat5_file_order(spark, d):
    """P5: folders first, then names."""
    f = table(spark, d, "files").where("uri is not null").groupBy("uri").agg(F.max("is_dir").alias("is_dir"), F.max(F.lower("name")).alias("name"), F.max("size").alias("size"))
    return global_rank(f, C.file_order("name")).select("uri", "place")


@query("select project, pos, idx from (select project, pos, idx, text from " + _BLOCKS + ") where contains(lower(text), 'kitob')")
def cat7_page_search(spark, d):
    """P7."""
    return C.search(_blocks(spark, d), "text", "Kitob", 2).select("project", "pos", "idx")


_LATEST = "(select * from (select *, row_number() over (partition by id order by updated_at desc, title nulls last, language nulls last, len(pages), detected_language nulls last) as n from project) where n = 1)"


def _latest(spark, d):
    return C.latest(table(spark, d, "project"), ["id"], [F.col("updated_at").desc(), F.col("title").asc_nulls_last(), F.col("language").asc_nulls_last(), F.size("pages").asc_nulls_last(), F.col("detected_language").asc_nulls_last()])


@query(f"""select id, cast(len(list_filter(pages, lambda p: p.ocrDone)) as int) as done, cast(coalesce(len(pages), 0) as int) as total, cast(case when len(pages) > 0 then len(list_filter(pages, lambda p: p.ocrDone)) * 100 // len(pages) else 0 end as int) as percent from {_LATEST}""")
def a12_progress(spark, d):
    """A12 over the latest state of every book (2.10)."""
    return C.progress(_latest(spark, d))


@query(f"""
with l as {_LATEST}, p as (select id as project, i - 1 as pos, pages[i].ocrDone and pages[i].confidence >= 60 as done from (select id, pages, unnest(range(1, len(pages) + 1)) as i from l)) select project, pos from p where not coalesce(done, false)""")
def cat8_to_do(spark, d):
    """Pages still to be recognised with some confidence."""
    pages = _latest(spark, d).select(F.col("id").alias("project"), F.posexplode("pages").alias("pos", "p"))
    return C.to_do(pages.select("project", "pos"), pages.where("p.ocrDone and p.confidence >= 60").select("project", "pos"))


@query(f"""
with l as {_LATEST} select id, array_to_string(list_transform(case when len(pages) > 2 then list_concat([pages[2]], [pages[3]], [pages[1]], pages[4:]) when len(pages) = 2 then [pages[2], pages[1]] else pages end, lambda p: p.id), ',') as moved, array_to_string(list_transform(list_filter(pages, lambda p: p.ocrDone), lambda p: p.id), ',') as kept from l""")
def cat10_page_lists(spark, d):
    """The first page moved by two, pages not done deleted."""
    moved = F.array_join(F.transform(C.move(F.col("pages"), 0, 2), lambda p: p["id"]), ",")
    return _latest(spark, d).select("id", moved.alias("moved"), F.array_join(F.transform(F.filter("pages", lambda p: p["ocrDone"]), lambda p: p["id"]), ",").alias("kept"))


@query("select distinct source, min(doc_id) over (partition by source) as first from documents")
def cat17_first_seen(spark, d):
    """P17."""
    return C.first_seen(table(spark, d, "documents"), "source", "doc_id")


@query(f"with b as {_BLOCKS}, p as (select project, pos, string_agg(text, ' ' order by idx) as text from b group by project, pos) select project, string_agg(text, chr(10) order by pos) as text from p where pos < 3 group by project")
def cat18_samples(spark, d):
    """P18."""
    pages = _blocks(spark, d).groupBy("project", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), " ").alias("text"))
    return C.sample_text(pages)


@query("""
select ord, name, case when n = 0 then name when contains(name, '.') then regexp_replace(name, '[.][^.]*$', '') || ' (' || n || ').' || list_extract(string_split(name, '.'), -1) else name || ' (' || n || ')' end as "unique"
from (select ord, name, row_number() over (partition by name order by ord) - 1 as n from (select doc_id as ord, coalesce(title, 'kitob') || '.' || lower(fmt) as name from documents))""")
def k8_unique_names(spark, d):
    """K8."""
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.coalesce("title", F.lit("kitob")), F.lit("."), F.lower("fmt")).alias("name"))
    return C.unique_names(wanted)


@query("select doc_id, sha1(text) as digest from documents where text is not null")
def k9_digests(spark, d):
    """K9."""
    files = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"))
    return K.digests(files).withColumnRenamed("name", "doc_id")


# ---------------------------------------------------------------- signals


_BINS = "(select camera, cast(floor(mean) as int) as bin, count(*) as n from (select distinct * from frames) where mean between 0 and 255 group by all)"


def _bins(spark, d):
    return I.histogram(table(spark, d, "frames").distinct(), ["camera"], "mean")


@query(f"select * from {_BINS}")
def i2_histogram(spark, d):
    """Brightness of each camera."""
    return _bins(spark, d)


@query(f"select camera, min(bin) as percentile from (select *, sum(n) over (partition by camera order by bin) as r, sum(n) over (partition by camera) as t from {_BINS}) where r >= 0.05 * t group by camera")
def i3_histogram_percentile(spark, d):
    """I3."""
    return I.histogram_percentile(_bins(spark, d), ["camera"], 0.05)


@query(f"""
with q as (select camera, bin, sum(n) over k as w0, sum(n * bin) over k as s0, sum(n) over (partition by camera) as w, sum(n * bin) over (partition by camera) as s from {_BINS} window k as (partition by camera order by bin)),
v as (select camera, bin, case when w > w0 then cast(w0 as double) * cast(w - w0 as double) * pow(s0 / cast(w0 as double) - (s - s0) / cast(w - w0 as double), 2) end as v from q)
select camera, cast(coalesce(arg_max(bin, {{'v': v, 'b': -bin}}) filter (where v is not null), 128) as int) as threshold from v group by camera""")
def i4_otsu(spark, d):
    """I4."""
    return I.otsu(_bins(spark, d), ["camera"])


@query("""
with e as (select vec_id, list_transform(embedding, lambda x: floor(cast(x as double) * 1000)) as v from embeddings)
select vec_id, list_transform(range(1, len(v) + 1), lambda i: list_sum(v[greatest(i - 3, 1) : i + 3]) / len(v[greatest(i - 3, 1) : i + 3])) as smooth from e""")
def i9_smoothing(spark, d):
    """I9 over array signals of whole numbers."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", I.smoothed(whole, F.lit(3)).alias("smooth"))


@query("""
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings), v as (select vec_id, list_transform(x, lambda y: y - list_avg(x)) as v, len(x) as n from e),
a as (select vec_id, n, list_transform(range(0, n), lambda k: list_dot_product(v[1 : n - k], v[k + 1 : n]) / (n - k)) as ac from v),
b as (select vec_id, n, ac, list_position(ac[4 : n // 2], list_max(ac[4 : n // 2])) + 2 as p from a),
h as (select vec_id, n, ac, p, case when p >= 6 and ac[p // 2 + 1] > 0.8 * ac[p + 1] then p // 2 else p end as q from b),
h2 as (select vec_id, n, ac, p, case when q < p and q >= 6 and ac[q // 2 + 1] > 0.8 * ac[q + 1] then q // 2 else q end as q from h)
select vec_id, case when ac[p + 1] > 0 then cast(round((q + case when ac[q] - 2 * ac[q + 1] + ac[q + 2] <> 0 then 0.5 * (ac[q] - ac[q + 2]) / (ac[q] - 2 * ac[q + 1] + ac[q + 2]) else 0 end) * 1000000) as bigint) end as pitch from h2""")
def i8_pitch(spark, d):
    """I8 over array signals, in millionths."""
    return table(spark, d, "embeddings").select("vec_id", F.round(I.pitch(F.col("embedding").cast("array<double>")) * 1_000_000).cast("bigint").alias("pitch"))


@query("select project, pos, width > height * 1.05 as spread from (select distinct project, pos, width, height from ocr_page)")
def i12_spreads(spark, d):
    """I12."""
    return table(spark, d, "ocr_page").select("project", "pos", I.looks_like_spread(F.col("width"), F.col("height")).alias("spread")).distinct()


@query("""
with recursive f as (select camera, ts, motion, coalesce(sharp, 0) as sharp, sharp as own, mean, cast(floor(epoch_us(ts) / 1000) as bigint) as ms, row_number() over (partition by camera order by ts, motion, mean, sharp nulls first) as n from (select distinct camera, ts, motion, sharp, mean from frames) where camera is not null and ts is not null and motion is not null and mean is not null),
s as (
  select camera, cast(0 as bigint) as n, 0 as still, 0 as moving, true as armed, cast(0 as bigint) as last, cast(0 as double) as best, false as fired from (select distinct camera from f)
  union all
  select camera, n, case when fired then 0 else still end, case when fired then 0 when not was and motion > 7 then moving + 1 else moving end, case when fired then false when was then true else not motion > 7 and moving >= 2 and motion < 3 and ms - last > 900 end, case when fired then ms else last end, best, fired
  from (select f.camera, f.n, f.ms, f.motion, s.armed as was, s.moving, s.last, greatest(s.best * 0.995, f.sharp) as best, case when s.armed then case when f.motion < 2.2 then s.still + 1 else 0 end else s.still end as still,
    s.armed and f.motion < 2.2 and s.still + 1 >= 9 and f.sharp >= greatest(s.best * 0.995, f.sharp) * 0.72 and f.mean > 35 as fired from s join f on f.camera = s.camera and f.n = s.n + 1))
select f.camera, epoch_us(f.ts) as at, f.own as sharp from s join f on f.camera = s.camera and f.n = s.n where s.fired""")
def t1_shots(spark, d):
    """The automatic shutter over the frames."""
    from leafmill.streaming.shots import shots_batch

    return shots_batch(table(spark, d, "frames")).select("camera", F.unix_micros("ts").alias("at"), "sharp")
