"""Interactive views: filters, rollups, gap-filled series, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table


@query("""
with d as (select cast(ts as date) as day, count(*) as n from events group by 1),
     r as (select min(day) as a, max(day) as b from d),
     s as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from r)
select s.day, coalesce(d.n, 0) as n, isodow(s.day) = 1 as is_monday from s left join d on s.day = d.day""")
def daily_counts_gapfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per calendar day between the first and the last event, with 0 where there is none."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    span = days.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))).alias("day"))
    return span.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.weekday("day") == 0).alias("is_monday"))


@query("""
with c as (select c_custkey, c_nationkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1, 2)
select coalesce(nullif(n_name, ''), 'UNKNOWN') as name, count(*) as release_count, count(*) filter (where n > 0) as covered_count, cast(sum(n) as bigint) as article_count
from c left join nation on c_nationkey = n_nationkey group by 1""")
def dept_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per department (nation): releases (customers), those with articles (orders), articles. Orders are counted per
    customer before the joins, so that only counts meet."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    name = F.coalesce(T.blank_to_null(F.col("n_name")), F.lit("UNKNOWN"))
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("release_count"), F.count_if(F.col("n") > 0).alias("covered_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("article_count"))


@query("select l_suppkey as publisher, count(*) as n from lineitem group by 1")
def publisher_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles per publisher, most first."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("publisher")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "publisher")


@query("select source as category, count(*) as n, min(doc_id) as first_seen from documents group by 1")
def category_counts_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per category; equal counts in the order in which they first appear."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query("""
with c as (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1)
select count(*) as releases, count(*) filter (where n > 0) as covered, cast(coalesce(sum(n), 0) as bigint) as articles,
       case when count(*) = 0 then 0 else cast(floor(100.0 * count(*) filter (where n > 0) / count(*) + 0.5) as bigint) end as rate from c""")
def coverage_totals_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases, covered ones, articles and the share in whole per cent, 0 of nothing."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    total = rows.agg(F.count("*").alias("releases"), F.count_if(F.col("n") > 0).alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("articles"))
    return total.withColumn("rate", F.when(F.col("releases") == 0, 0).otherwise(F.floor(F.col("covered") * 100 / F.col("releases") + 0.5)).cast("long"))


def _nation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    own = n.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return own.groupBy(F.col("n_name").alias("name")).agg(F.sum("n").alias("n"))


_NATIONS = """
with c as (select n_name as name, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1),
     k as (select *, row_number() over (order by n desc, name) as k from c),
     g as (select case when k <= 9 then name else 'OTHER' end as name, cast(sum(n) as bigint) as n, min(k) as k from k group by 1)
"""


def _top9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation, so that a window without partitions is a handful of rows."""
    counts = _nation_counts(spark, sf_dir).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "name")))
    return counts.groupBy(F.when(F.col("k") <= 9, F.col("name")).otherwise("OTHER").alias("name")).agg(F.sum("n").alias("n"), F.min("k").alias("k"))


@query(_NATIONS + "select name, n, round(n * 1.0 / sum(n) over (), 6) as share from g")
def top9_plus_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine largest and the rest as one, with shares."""
    return _top9(spark, sf_dir).select("name", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share")).orderBy(F.col("name") == "OTHER", F.desc("n"), "name")


@query(_NATIONS + "select name, n, cast(coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as begin_at from g")
def running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each slice of the chart begins."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return _top9(spark, sf_dir).select("name", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("begin_at"))


@query("""
with s as (select distinct user_id from events where event_type = 'purchase')
select cast(ts as date) as day, count(*) as total, count(s.user_id) as selected from events left join s using (user_id) group by 1""")
def day_group_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: rows, and rows whose id is in a set."""
    events = table(spark, sf_dir, "events")
    chosen = events.where("event_type = 'purchase'").select("user_id").distinct().withColumn("selected", F.lit(True))
    return events.join(chosen, "user_id", "left").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count("selected").alias("selected"))


@query("select cast(min(ts) as date) as first_day, cast(max(ts) as date) as last_day, greatest(cast(min(ts) as date), cast(max(ts) as date) - 6) as default_from from events")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day, and where the last seven days begin."""
    d = F.to_date("ts")
    return table(spark, sf_dir, "events").agg(F.min(d).alias("first_day"), F.max(d).alias("last_day"), F.greatest(F.min(d), F.date_sub(F.max(d), 6)).alias("default_from"))


@query("select distinct event_type, cast(ts as date) as day from events")
def distinct_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that filters offer."""
    return table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day")).distinct()


@query("""
select o_orderkey, count(*) as n from orders join lineitem on l_orderkey = o_orderkey
where o_orderdate >= '1994-01-01' and o_orderdate < '1997-01-01' and o_orderpriority = '1-URGENT'
group by 1 having count(*) filter (where l_returnflag = 'R' and l_quantity > 45) > 0""")
def nested_filter_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of a date range and department of which one article at least fulfils a condition. The dates reach the scan."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1994-01-01' and o_orderdate < timestamp_ntz '1997-01-01' and o_orderpriority = '1-URGENT'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("hits"))
    return orders.join(lines.where("hits > 0"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n")


KEYWORDS = ("the", "under", "token", "verein")


@query("""
select doc_id, array_to_string(list_filter(['the', 'under', 'token', 'verein'], lambda k: contains(lower(text), k)), ',') as keywords
from documents where contains(lower(text), 'the') or contains(lower(text), 'under') or contains(lower(text), 'token') or contains(lower(text), 'verein')""")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a keyword, with those that they contain."""
    low = F.lower("text")
    hit = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(low, k))
    return table(spark, sf_dir, "documents").where(T.any_phrase(low, KEYWORDS)).select("doc_id", F.array_join(hit, ",").alias("keywords"))


@query("""
select o_orderkey, case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then 2 else 1 end as importance
from orders order by importance desc, o_orderdate desc, o_orderkey limit 100""")
def importance_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most important, the latest first."""
    importance = F.lit(1)
    for name, n in (("4-NOT SPECIFIED", 2), ("3-MEDIUM", 3), ("2-HIGH", 4), ("1-URGENT", 5)):
        importance = F.when(F.col("o_orderpriority") == name, n).otherwise(importance)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", importance.alias("importance")).orderBy(F.desc("importance"), F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "importance")


@query("""
select n_name, case r_name when 'EUROPE' then 1 when 'ASIA' then 2 when 'AMERICA' then 3 else 4 end as rank from nation join region on n_regionkey = r_regionkey""")
def custom_rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed sources first, in their order, then the others by name."""
    listed = F.array(*[F.lit(x) for x in ("EUROPE", "ASIA", "AMERICA")])
    at = F.array_position(listed, F.col("r_name"))
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_name", F.when(at == 0, 4).otherwise(at).cast("int").alias("rank")).orderBy("rank", "n_name")


@query("""
with d as (select l_returnflag as stage, cast(round(l_quantity) as bigint) as calls, cast(round(l_extendedprice * 100) as bigint) as tokens from lineitem)
select coalesce(stage, 'TOTAL') as stage, cast(sum(calls) as bigint) as calls, cast(sum(tokens) as bigint) as tokens, cast(round(sum(tokens) * 0.25 / 1000000, 6) as double) as cost
from d group by rollup(stage)""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost per stage and in all."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stage"), F.round("l_quantity").cast("long").alias("calls"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("tokens"))
    total = rows.rollup("stage").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    return total.select(F.coalesce("stage", F.lit("TOTAL")).alias("stage"), "calls", "tokens", F.round(F.col("tokens").cast("decimal(38,0)") * F.lit("0.25").cast("decimal(3,2)") / 1000000, 6).cast("double").alias("cost"))


@query("""
with r as (select o_orderkey, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as k, o_orderpriority as category from orders)
select category, o_orderkey, o_totalprice, repeat('★', cast(6 - k as int)) || repeat('☆', cast(k - 1 as int)) as stars from r where k <= 5""")
def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first of each category with stars for their rank: the rows of the report by category."""
    from ..operators.tables import first_by

    rows = first_by(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), "o_orderkey", "o_totalprice"), ["category"], F.desc("o_totalprice"), F.col("o_orderkey"), n=5)
    k = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return rows.withColumn("k", k).select("category", "o_orderkey", "o_totalprice", T.stars(6 - F.col("k")).alias("stars"))
