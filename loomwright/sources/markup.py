"""Lists, links and feeds from pages that were fetched into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title(page: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def hrefs(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def links(pages: DataFrame, key: str, page: str, most: int) -> DataFrame:
    """key, url, k: the first `most` distinct links of each page."""
    found = pages.select(key, F.posexplode(F.slice(F.array_distinct(hrefs(F.col(page))), 1, most)).alias("pos", "url"))
    return found.select(key, "url", (F.col("pos") + 1).cast("int").alias("k"))


def feed_items(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """key, seq, title, url, publisher, published of a news feed; "title - publisher" is split at its last dash."""
    rows = feeds.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).alias("seq", "item"))

    def field(name: str) -> Column:
        raw = F.regexp_extract("item", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)
        bare = F.trim(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(a), F.lit(b))
        return bare

    whole = field("title")
    split = r"(?s)^(.*) - (.*?)$"
    has = F.rlike(whole, F.lit(split))
    return rows.select(
        key, "seq", F.when(has, F.regexp_extract(whole, split, 1)).otherwise(whole).alias("title"), field("link").alias("url"),
        F.when(has, F.regexp_extract(whole, split, 2)).otherwise(field("source")).alias("publisher"), published(field("pubDate")).alias("published"),
    )


def published(value: Column) -> Column:
    """The date in Korea of an RFC 822 moment; the weekday is taken off, as the parser refuses it."""
    bare = F.regexp_replace(value, r"^[A-Za-z]{3},\s*", "")
    zoned = F.coalesce(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))
    return F.date_from_unix_date(F.floor((F.unix_seconds(zoned) + 9 * 3600) / 86400).cast("int"))


def first_per_id(items: DataFrame, id_pattern: str, keys: list[str]) -> DataFrame:
    """The first item of each id in its address."""
    w = Window.partitionBy(*keys, "_id").orderBy("seq")
    return items.withColumn("_id", F.regexp_extract("url", id_pattern, 1)).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_id")
