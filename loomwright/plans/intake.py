"""Collection runs over the driver's tables: known links, counters, bounds, redirects, attachments, coverage by title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import text as T
from .registry import query, table


@query("""select p.page_id, case when d.doc_id is null then 'new' when p.page_id % 10 = 0 then 'always' else 'refetch' end as why from pages p left join documents d on page_id = doc_id
where d.doc_id is null or p.page_id % 10 = 0 or length(trim(coalesce(d.text, ''))) < 600""")
def links_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are not known, those of a source that is always fetched, and known ones whose item is not good enough."""
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), (F.length(F.trim(F.coalesce("text", F.lit("")))) < 600).alias("poor"))
    rows = table(spark, sf_dir, "pages").select("page_id").join(known, "page_id", "left")
    why = F.when(F.col("poor").isNull(), "new").when(F.col("page_id") % 10 == 0, "always").when(F.col("poor"), "refetch")
    return rows.select("page_id", why.alias("why")).where("why is not null")


@query("""with m as (select max(ts) as m from events) select event_id from events, m where ts >= m - interval 3 day or user_id in (select c_custkey from customer where c_acctbal > 0)""")
def kept_late_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the window, and late ones that are already known."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    start = table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("interval 3 days")).alias("s")).scalar()
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    fresh = events.where(F.col("ts") >= start)
    return fresh.unionByName(events.where(F.col("ts") < start).join(known, "user_id", "left_semi")).select("event_id")


@query("""select l_orderkey, l_linenumber, coalesce(case when o_orderstatus = 'P' then null else o_totalprice end, c_acctbal) as known from lineitem left join orders on l_orderkey = o_orderkey left join customer on c_custkey = l_suppkey""")
def bundle_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle's rows with what exists of each, else with what exists of its parent."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("own"))
    parent = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l_suppkey"), "c_acctbal")
    return lines.join(own, "l_orderkey", "left").join(parent, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("own", "c_acctbal").alias("known"))


@query("""select event_type as source, count(*) as found, count(*) filter (where value > 1) as stored, count(*) filter (where value <= 1) as skipped, count(*) filter (where value is null) as failed, coalesce(bool_and(value is not null), true) as ok from events group by 1
union all select 'none', 0, 0, 0, 0, true""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run did per source, and whether all went well; a run without rows went well."""
    v = F.col("value")
    counts = [F.count("*").alias("found"), F.count_if(v > 1).alias("stored"), F.count_if(v <= 1).alias("skipped"), F.count_if(v.isNull()).alias("failed"), F.coalesce(F.bool_and(v.isNotNull()), F.lit(True)).alias("ok")]
    events = table(spark, sf_dir, "events")
    none = events.where("event_type = 'no such source'").agg(*counts).select(F.lit("none").alias("source"), "*")
    return events.groupBy(F.col("event_type").alias("source")).agg(*counts).unionByName(none)


@query("""select count(*) as guarded, count(*) filter (where g = 'token') as token, count(*) filter (where g = 'toxic') as toxic from (select case when contains(text, 'token') then 'token' when toxic = 1 then 'toxic' end as g from documents left join labels using (doc_id)) where g is not null""")
def guard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each guard dropped; the first that holds counts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("token")).alias("token")).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    g = F.when(F.col("token"), "token").when(F.col("toxic") == 1, "toxic")
    return rows.select(g.alias("g")).where("g is not null").agg(F.count("*").alias("guarded"), F.count_if(F.col("g") == "token").alias("token"), F.count_if(F.col("g") == "toxic").alias("toxic"))


@query("""select o_custkey as source, min(o_orderdate) as oldest, count(*) filter (where o_orderdate >= timestamp '1996-01-01') as needed from orders group by 1""")
def oldest_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest date that a source's pages reached, and how many rows were needed."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.min("o_orderdate").alias("oldest"), F.count_if(F.col("o_orderdate") >= "1996-01-01").alias("needed"))


@query("""select o_custkey as sid, o_orderkey as seq, o_orderdate from orders where o_orderdate >= timestamp '1994-01-01' and o_orderdate < timestamp '1997-01-01' qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1""")
def backfill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows between two dates, the last one seen of each id."""
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1994-01-01") & (F.col("o_orderdate") < "1997-01-01"))
    return rows.groupBy(F.col("o_custkey").alias("sid")).agg(F.max(F.struct("o_orderkey", "o_orderdate")).alias("x")).select("sid", F.col("x.o_orderkey").alias("seq"), "x.o_orderdate")


@query(r"""select lower(regexp_extract(url, '^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host, arg_min(t, length(t) * 1000000 + page_id) as title from (select url, page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as t from pages) where t <> '' group by 1""")
def shortest_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest title per address, the first of equals."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = table(spark, sf_dir, "pages").select(T.url_host(F.col("url")).alias("host"), title.alias("title"), "page_id").where("title <> ''")
    return rows.groupBy("host").agg(F.min_by("title", F.struct(F.length("title"), "page_id")).alias("title"))


@query("""select page_id, 'b' || (page_id % 7) as list_id, cast(page_id * 3 as varchar) as seq from pages union all select page_id, 'b' || (page_id % 7), cast(page_id * 3 + 1 as varchar) from pages where page_id % 2 = 0""")
def view_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of list pages whose links are calls with a list and a number; here the calls are put into the pages first."""
    call = lambda seq: F.concat(F.lit("<a onclick=\"goView('b"), (F.col("page_id") % 7).cast("string"), F.lit("', '"), seq.cast("string"), F.lit("')\">x</a>"))
    html = F.concat(F.coalesce("html", F.lit("")), call(F.col("page_id") * 3), F.when(F.col("page_id") % 2 == 0, call(F.col("page_id") * 3 + 1)).otherwise(""))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(html, F.lit(r"goView\('[^']*',\s*'[^']*'\)"), F.lit(0))).alias("x"))
    part = lambda k: F.regexp_extract("x", r"goView\('([^']*)',\s*'([^']*)'\)", k)
    return rows.select("page_id", part(1).alias("list_id"), part(2).alias("seq"))


@query(r"""select page_id, case when page_id % 3 = 0 then url else 'https://search.example/r' end as link, regexp_replace(lower(regexp_extract(case when page_id % 3 < 2 then url else 'https://search.example/r' end, '^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') as publisher from pages where url is not null""")
def unwrapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a search feed: a redirect's target is in its query, and without a named source the host is the publisher."""
    page, url = F.col("page_id"), F.col("url")
    redirect = F.concat(F.lit("https://search.example/r?c=1&url="), F.url_encode(url), F.lit("&f=rss"))
    feed = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.when(page % 3 == 0, url).when(page % 3 == 1, redirect).otherwise("https://search.example/r").alias("link"))
    target = F.coalesce(F.try_url_decode(F.nullif(F.regexp_extract("link", r"[?&]url=([^&#]*)", 1), F.lit(""))), F.col("link"))
    return feed.select("page_id", F.regexp_replace("link", r"(search\.example/r)\?.*$", "$1").alias("link"), T.publisher_of(target).alias("publisher"))


@query(r"""with a as (select page_id, unnest(['/f/' || (page_id % 5) || '.pdf', '/f/x.hwp', '/f/x.hwp', '/f/y.docx', '/f/z.pdf', '/f/n.html']) as url, generate_subscripts([1, 2, 3, 4, 5, 6], 1) as pos from pages),
f as (select page_id, url, min(pos) as pos from a where regexp_matches(url, '\.(pdf|hwpx?|docx?)$') group by 1, 2)
select page_id, url, row_number() over (partition by page_id order by pos) as k from f qualify k <= 3""")
def attachment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three links to documents per page, each address once, in order; here the links are put into the pages first."""
    links = F.concat(F.lit('<a href="/f/'), (F.col("page_id") % 5).cast("string"), F.lit('.pdf">a</a><a href="/f/x.hwp">b</a><a href="/f/x.hwp">c</a><a href="/f/y.docx">d</a><a href="/f/z.pdf">e</a><a href="/f/n.html">f</a>'))
    urls = F.array_distinct(F.filter(F.regexp_extract_all(links, F.lit(r'href="([^"]*)"'), F.lit(1)), lambda u: F.rlike(u, F.lit(r"\.(pdf|hwpx?|docx?)$"))))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.slice(urls, 1, 3)).alias("p", "url")).select("page_id", "url", (F.col("p") + 1).cast("long").alias("k"))


@query(r"""select page_id, url || case when contains(url, '?') then '&' else '?' end || 'seq=' || page_id as detail, coalesce(try_cast(regexp_extract(html, '(\d{4}-\d{2}-\d{2})', 1) as date), date '2024-01-01') as day from pages where url is not null and not contains(url, '#')""")
def detail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of a row's page by its number, and its date; a row without a date has the run's."""
    url = F.col("url")
    detail = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("seq="), F.url_encode(F.col("page_id").cast("string")))
    day = F.coalesce(F.try_to_date(F.regexp_extract("html", r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "pages").where(url.isNotNull() & ~F.contains(url, F.lit("#"))).select("page_id", detail.alias("detail"), day.alias("day"))


@query("""select o_orderkey, o_orderdate from orders where o_custkey = 7 and o_orderdate >= (select max(o_orderdate) from orders) - interval 900 day order by o_orderdate desc, o_orderkey limit 20""")
def release_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's latest releases of the last days."""
    orders = table(spark, sf_dir, "orders")
    start = orders.agg((F.max("o_orderdate") - F.expr("interval 900 days")).alias("s")).scalar()
    return orders.where((F.col("o_custkey") == 7) & (F.col("o_orderdate") >= start)).select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)


@query("""select event_id, user_id from (select *, row_number() over (partition by event_type order by ts, event_id) as k from events where not coalesce(value > 3, false)) where k <= 5""")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not done yet, so many per run and kind, the oldest first."""
    from ..operators.tables import first_by

    rows = table(spark, sf_dir, "events").where(~F.coalesce(F.col("value") > 3, F.lit(False))).select("event_id", "user_id", "event_type", "ts")
    return first_by(rows, ["event_type"], F.col("ts"), F.col("event_id"), n=5).select("event_id", "user_id")


@query("""with r as (select s_suppkey as id, s_nationkey as k, s_acctbal as v from supplier), a as (select c_custkey as url, c_nationkey as k, c_acctbal as v, c_custkey % 5 = 0 as undated from customer)
select r.id, a.url from a join r using (k) where abs(a.v - r.v) / 1000 <= 0.6 and case when undated then abs(a.v - r.v) / 1000 <= 0.4 else true end and not exists (select 1 from orders where o_custkey = a.url and o_orderkey % 40 = 0)""")
def accepted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each release that are near enough (undated ones must be nearer) and not among its articles yet."""
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("w"), (F.col("c_custkey") % 5 == 0).alias("undated"))
    # a distance of at most 600 lies in the same or a neighbouring band of 600
    band = lambda c: F.floor(c / 600)
    near = r.withColumn("b", F.explode(F.array(*[band(F.col("v")) + d for d in (-1, 0, 1)])))
    gap = F.abs(F.col("w") - F.col("v")) / 1000
    met = a.withColumn("b", band(F.col("w"))).join(near, ["k", "b"]).where((gap <= 0.6) & (~F.col("undated") | (gap <= 0.4)))
    done = table(spark, sf_dir, "orders").where("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("url")).distinct()
    return met.join(done, "url", "left_anti").select("id", "url")


_STOP = ("the", "of", "and")
_TOK = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace({}, '[^0-9A-Za-z가-힣\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2 and not regexp_full_match(w, '\d+') and w not in ('the', 'of', 'and')))"


@query(f"""with n as (select n_nationkey as id, 'special ' || n_name || ' order of ' || r_name as title from nation join region on n_regionkey = r_regionkey), r as (select id, {_TOK.format('title')} as rt from n),
a as (select s_suppkey as url, 'special ' || n_name || ' item ' || (s_suppkey % 3) || ' and order' as t from supplier join nation on s_nationkey = n_nationkey), b as (select url, {_TOK.format('t')} as ats from a),
s as (select url, id, len(list_filter(rt, lambda x: len(list_filter(ats, lambda y: contains(y, x) or contains(x, y))) > 0)) / len(rt) as score from b, r)
select url, id, score from (select *, row_number() over (partition by url order by score desc, id) as k from s where score >= 0.6) where k = 1""")
def best_release_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's best release by title similarity of 0.6 or more, the first of equals. Titles meet by the pairs of
    adjacent characters that a token contained in another must share, so no article meets all releases."""
    nation = table(spark, sf_dir, "nation")
    named = nation.join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    title = F.concat(F.lit("special "), "n_name", F.lit(" order of "), "r_name")
    r = named.select(F.col("n_nationkey").alias("id"), M.tokens(title, stop_words=_STOP).alias("rt"))
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey").join(nation, "n_nationkey")
    a = s.select(F.col("s_suppkey").alias("url"), M.tokens(F.concat(F.lit("special "), "n_name", F.lit(" item "), (F.col("s_suppkey") % 3).cast("string"), F.lit(" and order")), stop_words=_STOP).alias("at"))
    return M.best_by_title(r, a, 0.6)
