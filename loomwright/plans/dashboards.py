"""Filters and statistics of dashboards and archives over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table


def in_set(value: Column, wanted: Column) -> Column:
    """Whether a value is enabled: an empty set enables all."""
    return (F.size(wanted) == 0) | F.array_contains(wanted, value)


def limited(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by an order, all of them for 0."""
    return df.orderBy(*order).limit(n) if n else df


@query("""select o_orderkey, o_orderdate from orders where o_orderdate between timestamp '1994-02-01' and timestamp '1995-03-31' and o_orderpriority = '2-HIGH' and o_orderstatus = 'F' and contains(cast(o_orderkey as varchar), '7')
union all select o_orderkey, o_orderdate from orders where o_orderdate = (select max(o_orderdate) from orders) and o_orderstatus <> 'F'""")
def archive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive by range, office, selected rows and part of a title; and by one exact date. The date reaches the scan."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    has = lambda part: F.contains(F.col("o_orderkey").cast("string"), F.lit(part))
    some = rows.where(F.col("o_orderdate").between("1994-02-01", "1995-03-31") & (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F") & has("7"))
    latest = rows.agg(F.max("o_orderdate").alias("d")).scalar()
    exact = rows.where((F.col("o_orderdate") == latest) & (F.col("o_orderstatus") != "F"))
    return some.unionByName(exact).select("o_orderkey", "o_orderdate")


@query("select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n from orders where contains(strftime(o_orderdate, '%Y-%m-%d'), '-11-2') group by 1")
def report_list_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose date has a part in it."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(day.alias("day")).where(F.contains("day", F.lit("-11-2"))).groupBy("day").agg(F.count("*").alias("n"))


@query("""select event_id, event_type from events where cast(ts as date) between (select cast(min(ts) as date) + 1 from events) and (select cast(min(ts) as date) + 9 from events) and event_type in ('click', 'purchase')
 and (contains(lower(event_type), 'ur') or contains(cast(event_id as varchar), '77') or contains(cast(user_id as varchar), '77') or contains(lower(coalesce(props, '')), '77'))""")
def dashboard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of days, sources, and a keyword in any of four fields."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min(F.to_date("ts")).alias("d")).scalar()
    day = F.to_date("ts")
    has = lambda c, part: F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(part))
    hit = has("event_type", "ur") | has("event_id", "77") | has("user_id", "77") | has("props", "77")
    return events.where(day.between(F.date_add(first, 1), F.date_add(first, 9)) & F.col("event_type").isin("click", "purchase") & hit).select("event_id", "event_type")


@query("""select 'all' as sources, event_type, count(*) as n from events where coalesce(value > -1, true) group by 2 union all select 'two', event_type, count(*) from events where event_type in ('click', 'view') and coalesce(value > -1, true) group by 2""")
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of enabled sources (without a flag a source is enabled); an empty set of chosen ones means all."""
    rows = table(spark, sf_dir, "events").where(F.coalesce(F.col("value") > -1, F.lit(True)))
    arms = [rows.where(in_set(F.col("event_type"), F.array(*[F.lit(x) for x in chosen]).cast("array<string>"))).groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(name).alias("sources"), "event_type", "n") for name, chosen in (("all", ()), ("two", ("click", "view")))]
    return arms[0].unionByName(arms[1])


@query("""with t as (select max(ts) as m from events), a as (select event_id, case when user_id % 11 = 0 then null else ts end as created, value > 5 as expired, event_type from events),
b as (select * from a where event_type = 'purchase' and not coalesce(expired, false) and (created is null or isodow(created) < 6 and created >= (select m from t) - interval 14 day))
select event_id, row_number() over (order by created nulls first, event_id) as place from b qualify place <= 300""")
def artifact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of a name that have not expired, of weekdays of the last two weeks, oldest first; a bad date comes first."""
    events = table(spark, sf_dir, "events")
    latest = events.agg(F.max("ts").alias("m")).scalar()
    created = F.when(F.col("user_id") % 11 != 0, F.col("ts"))
    rows = events.select("event_id", created.alias("created"), "event_type", "value").where((F.col("event_type") == "purchase") & ~F.coalesce(F.col("value") > 5, F.lit(False)))
    rows = rows.where(F.col("created").isNull() | (F.weekday("created") < 5) & (F.col("created") >= latest - F.expr("interval 14 days")))
    top = rows.orderBy(F.asc_nulls_first("created"), "event_id").limit(300)
    order = F.array_sort(F.collect_list(F.struct(F.col("created").isNotNull().alias("k"), "created", "event_id")))
    return top.agg(order.alias("o")).select(F.posexplode("o").alias("p", "x")).select("x.event_id", (F.col("p") + 1).cast("long").alias("place"))


@query("""select page_id, substr(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 40) as title, substr(url, 1, 10) as day from pages where trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' and coalesce(url, '') <> ''""")
def nonempty_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose title and date are not empty once they are cast and cut."""
    title = F.substring(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, 40)
    rows = table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.substring("url", 1, 10).alias("day"))
    return rows.where((F.col("title") != "") & (F.coalesce("day", F.lit("")) != ""))


_FILTERED = "o as (select * from orders where o_orderdate >= timestamp '1995-01-01' and o_orderpriority in ('1-URGENT', '3-MEDIUM'))"


@query(f"with {_FILTERED} select coalesce(nullif(o_orderpriority, ''), 'UNKNOWN') as publisher, count(*) as articles, count(distinct o_custkey) as releases from o group by 1")
def filtered_publisher_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers of what a filter leaves."""
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1995-01-01") & F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"))
    return rows.groupBy(F.coalesce(F.nullif("o_orderpriority", F.lit("")), F.lit("UNKNOWN")).alias("publisher")).agg(F.count("*").alias("articles"), F.countDistinct("o_custkey").alias("releases"))


@query(f"with {_FILTERED}, c as (select o_custkey, count(*) as n from o group by 1) select n_name as department, count(*) as releases, cast(sum(n) as bigint) as articles from c join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1")
def filtered_department_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departments of what a filter leaves; articles are counted per release before the joins."""
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1995-01-01") & F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    named = rows.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(table(spark, sf_dir, "nation"), "n_nationkey")
    return named.groupBy(F.col("n_name").alias("department")).agg(F.count("*").alias("releases"), F.sum("n").alias("articles"))


@query("select count(distinct cast(ts as date)) as days, count(*) as total, count(*) filter (where event_type = 'purchase') as selected from events")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, rows and selected rows of an archive."""
    return table(spark, sf_dir, "events").agg(F.countDistinct(F.to_date("ts")).alias("days"), F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("selected"))


@query("select source, count(*) as n from documents where source is not null group by 1 order by n desc, source limit 6")
def category_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent categories."""
    return table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(6)


@query("select 'all' as items, doc_id from documents union all (select 'ten', doc_id from documents order by doc_id limit 10)")
def max_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most so many items in the order of the input; 0 means all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return limited(docs, 0, F.col("doc_id")).select(F.lit("all").alias("items"), "doc_id").unionByName(limited(docs, 10, F.col("doc_id")).select(F.lit("ten").alias("items"), "doc_id"))


@query()
def names_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names in Korean order: those with the ten first names of each nation."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.collate("c_name", "ko").alias("name"))
    return rows.groupBy("c_nationkey").agg(F.min("name").alias("first")).orderBy("first")


@query("""with w as (select max(cast(ts as date)) as a, max(cast(ts as date)) filter (where event_type = 'purchase') as b from events), s as (select user_id, max(value) as score from events where event_type = 'purchase' group by 1)
select e.event_id, case when a = b then s.score end as score from events e cross join w left join s using (user_id) where event_type = 'click' and (a <> b or s.user_id is not null)""")
def enriched_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A briefing with a model's selection if both are of one window, else as it is."""
    events = table(spark, sf_dir, "events")
    same = events.agg((F.max(F.to_date("ts")) == F.max(F.when(F.col("event_type") == "purchase", F.to_date("ts")))).alias("same")).scalar()
    chosen = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("score"), F.lit(True).alias("hit"))
    rows = events.where("event_type = 'click'").join(chosen, "user_id", "left")
    return rows.where(~same | F.col("hit").isNotNull()).select("event_id", F.when(same, F.col("score")).alias("score"))


@query("""select user_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list(distinct event_type), lambda t: case t when 'view' then 'click' when 'search' then 'gone' else t end), lambda t: t in ('click', 'purchase', 'login')))), ',') as sources from events group by 1""")
def migrated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen sources under their present ids: retired ones are renamed, unknown ones go."""
    own = F.collect_set("event_type")
    renamed = F.transform(own, lambda t: F.when(t == "view", "click").when(t == "search", "gone").otherwise(t))
    known = F.array_intersect(renamed, F.array(*[F.lit(x) for x in ("click", "purchase", "login")]))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_distinct(known)), ",").alias("sources"))


@query("""with done as (select l_orderkey, count(*) as n from lineitem where l_linestatus = 'F' group by 1), want as (select l_orderkey, count(*) as n from lineitem group by 1)
select o_orderkey from orders where o_orderkey not in (select d.l_orderkey from done d join want w using (l_orderkey) where d.n = w.n)""")
def artifact_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that were not processed, or whose folder lost some of its files since."""
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("want"), F.count_if(F.col("l_linestatus") == "F").alias("have"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(files.where("have = want and have > 0").select("o_orderkey"), "o_orderkey", "left_anti")


@query(r"""select page_id, coalesce(nullif(regexp_extract(html, '(\d{4}-\d{2}-\d{2})', 1), ''), '20' || substr(lpad(cast(page_id as varchar), 6, '0'), 1, 6)) as day, lower(regexp_extract(url, '^https?://(?:www\.)?([^/?#:]*)', 1)) as label from pages""")
def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's date from its text, else from the digits of its name; a source's short label without what all share."""
    day = F.coalesce(F.nullif(F.regexp_extract("html", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.concat(F.lit("20"), F.substring(F.lpad(F.col("page_id").cast("string"), 6, "0"), 1, 6)))
    return table(spark, sf_dir, "pages").select("page_id", day.alias("day"), T.publisher_of(F.col("url")).alias("label"))
