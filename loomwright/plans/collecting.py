"""Collection and retention: windows, deduplication, upserts, text quality, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timewin as W
from ..operators import tables
from .registry import query, table

_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Phrases that occur in the synthetic documents, in the place of the defaults for news in Korean.
MARKS, NOISE, HARD = (".", "!!"), ("permission", "warranty", "copyright"), ("copyright",)


@query("""
with w as (select date_trunc('day', ts - interval 8 hour) + interval 32 hour as e from events),
     x as (select case isodow(e) when 6 then e + interval 2 day when 7 then e + interval 1 day else e end as window_end from w)
select window_end, case when isodow(window_end) = 1 then 72 else 24 end as hours, count(*) as n from x group by 1, 2""")
def briefing_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per briefing window: 24 hours up to a fixed hour on weekdays, 72 on Mondays."""
    rows = table(spark, sf_dir, "events").select(W.window_end(F.col("ts")).alias("window_end")).groupBy("window_end").agg(F.count("*").alias("n"))
    return rows.select("window_end", W.window_hours(F.col("window_end")).alias("hours"), "n")


def _member(spark: SparkSession, sf_dir: str, closed: bool) -> DataFrame:
    # even ids carry a date, odd ones a moment, every tenth nothing
    raw = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    start, end = F.lit("2024-01-08 08:00:00").cast("timestamp"), F.lit("2024-01-09 08:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("value")).where(W.in_window(F.col("value"), start, end, missing=closed, closed=closed)).select("event_id")


@query("""
select event_id from events where event_id % 10 = 0
 or (event_id % 2 = 0 and cast(ts as date) between '2024-01-08' and '2024-01-09')
 or (event_id % 2 = 1 and date_trunc('second', ts) between '2024-01-08 08:00:00' and '2024-01-09 08:00:00')""")
def window_membership_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a collection window: days count at both ends, what has no date belongs to it."""
    return _member(spark, sf_dir, True)


@query("""
select event_id from events where event_id % 10 <> 0 and (
 (event_id % 2 = 0 and cast(ts as date) >= '2024-01-08' and cast(ts as date) < '2024-01-09')
 or (event_id % 2 = 1 and date_trunc('second', ts) >= '2024-01-08 08:00:00' and date_trunc('second', ts) < '2024-01-09 08:00:00'))""")
def window_membership_halfopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a report window: its last day does not count, nor does what has no date."""
    return _member(spark, sf_dir, False)


@query("select o_orderkey from orders where o_orderkey % 7 <> 0 and o_orderdate >= (select max(o_orderdate) - interval 90 day from orders)")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not older than 90 days before the last; rows without a date go."""
    orders = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    cutoff = orders.agg((F.max("o_orderdate").cast("timestamp") - F.expr("interval 90 days")).alias("cutoff"))
    return orders.select("o_orderkey", value.alias("value")).where(W.retained(F.col("value"), cutoff.scalar())).select("o_orderkey")


@query("""
select user_id, event_type, event_id, ts, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) as k from events) where k = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key, the first of equals."""
    return tables.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "ts", "event_id")


@query("select event_type, event_id from (select *, row_number() over (partition by event_type order by event_id) as k from events) where k <= 20")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty links of each source."""
    return tables.first_by(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], F.col("event_id"), n=20)


@query("""
with o as (select user_id, count(*) as n, max(value) as top from events where event_id % 3 <> 0 group by 1), w as (select user_id, count(*) as n from events where event_id % 3 = 0 group by 1)
select user_id, case when w.n is not null then w.n else o.n end as n, o.top from o full join w using (user_id)""")
def upsert_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows over old ones by key; a column that only the old rows have stays."""
    events = table(spark, sf_dir, "events")
    old = events.where("event_id % 3 <> 0").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return tables.upserted(old, events.where("event_id % 3 = 0").groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("select count(*) as newly_collected from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R' and l_orderkey is not null)")
def new_ids_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids are new."""
    known = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(known, "o_orderkey", "left_anti").agg(F.count("*").alias("newly_collected"))


@query(f"select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g'))) as digest from documents")
def normalize_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_space(F.col("text"))).alias("digest"))


@query("select doc_id, md5(lower(regexp_replace(coalesce(text, ''), '[^0-9A-Za-z가-힣]', '', 'g'))) as digest from documents")
def semantic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.semantic_key(F.col("text"))).alias("digest"))


_SCORED = f"""
with t as (select doc_id, text, lang, trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) as n from documents),
     s as (select *, case when n = '' then -1000 else least(length(n), 1200)
       + least(300, 30 * ((length(n) - length(replace(n, '.', ''))) + (length(n) - length(replace(n, '!!', ''))) // 2))
       - 350 * (contains(lower(n), 'permission')::int + contains(lower(n), 'warranty')::int + contains(lower(n), 'copyright')::int) - case when length(n) < 120 then 500 else 0 end end as score from t)
"""


@query(_SCORED + "select doc_id, cast(score as int) as score from s")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a text as a summary."""
    return table(spark, sf_dir, "documents").select("doc_id", T.quality_score(F.col("text"), F.col("lang"), MARKS, NOISE).alias("score"))


@query(_SCORED + """select doc_id from s where length(n) < 120 or contains(lower(n), 'copyright')
 or contains(lower(n), 'permission')::int + contains(lower(n), 'warranty')::int + contains(lower(n), 'copyright')::int >= 2 or score < 100""")
def low_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no use as a summary."""
    return table(spark, sf_dir, "documents").where(T.low_quality(F.col("text"), F.col("lang"), HARD, MARKS, NOISE)).select("doc_id")


@query("select page_id, 'src-' || substr(sha1(url), 1, 16) as id from pages")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from addresses."""
    return table(spark, sf_dir, "pages").select("page_id", T.stable_id(F.lit("src"), F.col("url")).alias("id"))


@query(r"""
select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') as publisher, regexp_extract(url, '[?&]page=([^&#]*)', 1) as page,
       contains(url, '/en/') and not contains(url, 'utm_') as wanted from pages""")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publisher, a query parameter, and whether an address has all of the wanted parts and none of the unwanted."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.publisher_of(u).alias("publisher"), T.query_value(u, "page").alias("page"), (F.contains(u, F.lit("/en/")) & ~F.contains(u, F.lit("utm_"))).alias("wanted"))


@query("""
select url, min(page_id) as page_id, count(*) as n from pages group by 1""")
def first_seen_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each address."""
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
