"""Pages, feeds and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir
from ..operators.versions import Groups, merged_entries, streamed
from ..sources import markup
from ..streaming import incremental
from .registry import query, table


@query(r"""select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as title,
 len(regexp_extract_all(html, '(?i)<a\s[^>]*href="[^"]*"')) as links from pages""")
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's title as it is marked up, and how many links it has."""
    return table(spark, sf_dir, "pages").select("page_id", markup.title(F.col("html")).alias("title"), F.size(markup.hrefs(F.col("html"))).cast("long").alias("links"))


@query(r"""
with l as (select page_id, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) as u from pages), x as (select page_id, unnest(u) as url, generate_subscripts(u, 1) as pos from l),
     f as (select page_id, url, min(pos) as pos from x group by 1, 2)
select page_id, url, cast(k as int) as k from (select *, row_number() over (partition by page_id order by pos) as k from f) where k <= 20""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty distinct links of each page, in order."""
    return markup.links(table(spark, sf_dir, "pages"), "page_id", "html", 20)


@query("""
select event_type, user_id, count(*) as n, max(ts) as last_ts from events group by 1, 2""")
def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and latest moment per key, merged batch by batch from a file stream; equal to one batch over all rows."""
    return incremental.merged_counts(spark, f"{sf_dir}/events.parquet", ["event_type", "user_id"], "ts")


_ENTRY = "user_id bigint, last timestamp_ntz, items array<struct<event_type:string,ts:timestamp_ntz,event_id:bigint>>"


@query("""
with f as (select user_id, event_type, min(struct_pack(ts := ts, event_id := event_id)) as x from events group by 1, 2), l as (select user_id, max(ts) as last from events group by 1)
select user_id, strftime(last, '%Y-%m-%d %H:%M:%S') as last, count(*) as n_items, string_agg(event_type || ':' || x.event_id, ',' order by x.ts, x.event_id) as items from f join l using (user_id) group by user_id, l.last""")
def versioned_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event of each type, kept in a versioned table that a stream of files merges batch by batch."""
    root = f"{shared_dir(spark)}/state/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    events.repartitionByRange(4, "event_id").write.parquet(f"{root}/in")

    def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
        first = batch.groupBy("user_id", "event_type").agg(F.max("ts").alias("last"), F.min(F.struct("ts", "event_id")).alias("x"))
        entry = first.groupBy("user_id").agg(F.max("last").alias("last"), F.collect_list(F.struct("event_type", "x.ts", "x.event_id")).alias("items"))
        # the later of two moments stays
        later = state.select("user_id", F.col("last").alias("_last"))
        entry = entry.join(later, "user_id", "left").select("user_id", F.greatest("last", "_last").alias("last"), "items")
        return merged_entries(state, entry, "user_id", "items", ["event_type"], lambda x: F.struct(x["ts"], x["event_id"]))

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    state = streamed(stream, f"{root}/table", _ENTRY, merge, f"{root}/checkpoint")
    text = F.array_join(F.transform("items", lambda x: F.concat(x["event_type"], F.lit(":"), x["event_id"].cast("string"))), ",")
    return state.select("user_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), F.size("items").cast("long").alias("n_items"), text.alias("items"))


@query("""
select source as "group", cast(doc_id as varchar) as name, sha256(case when source < 'src2' then 'new ' || text else text end) as sha256 from documents""")
def published_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's group, published, published again unchanged, and again with some groups changed."""
    groups = Groups(spark, f"{shared_dir(spark)}/groups/{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("group"), F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    groups.published(files, 1)
    groups.published(files, 2)
    groups.published(files.where("group < 'src2'").withColumn("content", F.concat(F.lit("new ").cast("binary"), "content")), 3)
    return groups.read().select("group", "name", F.sha2("content", 256).alias("sha256"))
