"""Text of selected nodes, and dates in whatever form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..sources import nodes
from .registry import query, table

_PIECE = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)|<[/!?a-z][^>]*>|[^<]+|<"
_VOID = ", ".join(f"'{x}'" for x in nodes.VOID)
_CLEAN = "array_to_string(list_filter(list_transform(string_split(replace({}, chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
_UNESCAPED = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&')"
_OPTIONAL = ", ".join(f"'{x}'" for x in nodes.OPTIONAL)
#: Tags and texts of pages as rows, and the elements' intervals.
_TREE = rf"""
r as (select page_id, unnest(xs) as raw, generate_subscripts(xs, 1) - 1 as pos from (select page_id, regexp_extract_all(coalesce(html, ''), '{_PIECE}') as xs from pages)),
t as (select *, regexp_matches(raw, '(?i)\A</?[a-z]') and not regexp_matches(raw, '(?i)\A<(?:script|style)\b') as tag, lower(regexp_extract(raw, '(?i)\A</?([a-z][a-z0-9-]*)', 1)) as nm from r),
s as (select *, case when not tag then 0 when starts_with(raw, '</') then case when nm in ({_VOID}) then 0 else -1 end when regexp_matches(raw, '/\s*>\z') or nm in ({_VOID}) then 0 else 1 end as step,
      case when tag then regexp_extract(raw, '(?is)\sclass\s*=\s*"([^"]*)"', 1) end as css from t),
d as (select *, sum(step) over (partition by page_id, nm order by pos) + case when step < 0 then 1 else 0 end as depth from s where step <> 0),
sp as (select *, min(case when step < 0 then pos end) over (partition by page_id, nm, depth order by pos rows between 1 following and unbounded following) as own,
       case when nm in ({_OPTIONAL}) then min(case when step > 0 then pos end) over (partition by page_id, nm order by pos rows between 1 following and unbounded following) end as again from d),
pa as (select x.page_id, x.pos, min(y.own) as around from sp x join sp y on x.page_id = y.page_id and y.step > 0 and x.pos between y.pos and y.own where x.step > 0 and x.own is null group by 1, 2),
iv as (select page_id, nm, css, pos as b, coalesce(own, least(coalesce(again, around, 2147483647), coalesce(around, 2147483647))) as e from sp left join pa using (page_id, pos) where step > 0)"""


@query(rf"""
with {_TREE},
a as (select x.* from iv x where nm = 'article' and not exists (from iv y where y.page_id = x.page_id and y.nm = 'article' and y.b < x.b and y.e > x.b)),
p as (select x.* from iv x where nm = 'p' and exists (from a where a.page_id = x.page_id and x.b > a.b and x.b < a.e)),
o as (select x.* from p x where not exists (from p y where y.page_id = x.page_id and y.b < x.b and y.e > x.b)),
j as (select * from iv where nm = 'aside' or nm = 'nav' or list_contains(string_split(css, ' '), 'ad')),
x as (select o.page_id, o.b, s.pos, s.raw from o join s on o.page_id = s.page_id and s.pos > o.b and s.pos < o.e
      where not s.tag and not starts_with(s.raw, '<!') and not regexp_matches(s.raw, '(?i)\A<(?:\?|script|style)') and not exists (from j where j.page_id = s.page_id and s.pos between j.b and j.e))
select page_id, cast(b as int) as begin_at, {_CLEAN.format(_UNESCAPED.format("string_agg(raw, chr(10) order by pos)"))} as text from x group by page_id, b""")
def article_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph of a page's articles, without asides, menus and adverts in it."""
    found = nodes.node_texts(table(spark, sf_dir, "pages"), "page_id", "html", "article p", ("aside", "nav", ".ad"), first_only=False)
    return found.select("page_id", F.col("begin").alias("begin_at"), "text")


_PATHS = ("header", "article", "div.content", "main p")


@query()
def best_node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several selectors, the one whose first element has the best text; held against a parser with a stack in pytest."""
    return nodes.best_text(table(spark, sf_dir, "pages"), "page_id", "html", _PATHS, T.quality_score(F.col("text"), F.lit("")), ("nav", "aside", "footer", ".ad"))


_FORMS = ("yyyy. M. d.", "yyyy년 M월 d일", "yy-MM-dd", "d MMM yyyy", "MMMM d, yyyy", "yyyyMMdd", "yyyy/MM/dd")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def stated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date, written in one of several forms amid other words, and read back."""
    orders = table(spark, sf_dir, "orders")
    # years of two digits are always of this century
    n = F.when(F.year("o_orderdate") < 2000, F.lit(1)).otherwise((F.col("o_orderkey") % len(_FORMS) + 1).cast("int"))
    form = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in _FORMS]), n)
    early = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("d MMM yyyy", "MMMM d, yyyy", "yyyyMMdd")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("posted "), F.when(F.year("o_orderdate") < 2000, early).otherwise(form), F.lit(" by "), F.col("o_orderpriority"))
    return orders.select("o_orderkey", D.any_date(text, F.lit("2030-06-15").cast("date")).cast("string").alias("day"))


_MOMENTS = (("yyyy-MM-dd'T'HH:mm:ss", "Z"), ("yyyy-MM-dd HH:mm:ss", "+00:00"), ("yyyy.MM.dd HH:mm:ss", " UTC"), ("E, dd MMM yyyy HH:mm:ss", " GMT"))


@query("select event_id, epoch(date_trunc('second', ts)) as seconds from events")
def stated_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's moment to the second, written in one of several forms and read back."""
    form = F.element_at(F.array(*[F.concat(F.date_format("ts", f), F.lit(z)) for f, z in _MOMENTS]), (F.col("event_id") % len(_MOMENTS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(D.moment(form)).cast("double").alias("seconds"))
