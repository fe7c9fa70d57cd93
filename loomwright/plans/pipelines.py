"""The workloads end to end, as functions of DataFrames: collection, selection, coverage, report input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bodies as B
from ..functions import matching as M
from ..functions import text as T
from ..functions import timewin as W
from ..functions.dates import any_date
from ..functions.titles import first_title, other_office
from ..operators import blocks, overlap, tables
from ..operators import contracts as C
from ..operators.lineage import checkpointing
from ..sources import nodes


def usable(generic: Sequence[str], notices: Sequence[str], hard: Sequence[str] = T.HARD_FAILURE_PHRASES) -> Column:
    """Items with a real title, and a summary of 40 characters or more that is no error page and no copy of the title."""
    title, summary = T.normalize_space(F.col("title")), T.normalize_space(F.col("summary"))
    real = (F.length(title) >= 5) & ~T.any_phrase(title, generic) & ~T.any_phrase(title, notices)
    return real & (F.length(summary) >= 40) & ~T.any_phrase(F.lower(summary), [p.lower() for p in hard]) & ~T.has_repeated_title(F.col("summary"), F.col("title"))


def collected(old: DataFrame, new: DataFrame, names: DataFrame, window_end: Column, retention_days: int, cap: int, generic: Sequence[str] = (), notices: Sequence[str] = ()) -> DataFrame:
    """What is stored after a run: new items over old ones by id, within retention, usable, the latest of each address
    and title, under the sources' present names, the newest first up to a cap; `fresh` marks the last window's.

    Items: id, sourceId, source, title, date, url, summary, collectedAt."""
    rows = tables.upserted(old, new, "id")
    day = T.first_value(F.col("publishedAt") if "publishedAt" in rows.columns else F.lit(None), F.col("date"), F.col("collectedAt"))
    rows = rows.where(W.retained(day, window_end - F.make_dt_interval(days=F.lit(retention_days)))).where(usable(generic, notices))
    rows = rows.withColumn("_k", F.concat(T.normalize_space(F.col("url")), F.lit("::"), T.normalize_space(F.col("title"))))
    others = [c for c in rows.columns if c != "_k"]
    best = rows.groupBy("_k").agg(F.max_by(F.struct(*others), F.struct(F.coalesce("collectedAt", F.lit("")), F.col("id"))).alias("r")).select("r.*")
    named = best.join(names.select(F.col("id").alias("sourceId"), F.col("name").alias("_name")), "sourceId", "left").withColumn("source", F.coalesce("_name", "source")).drop("_name")
    start = window_end - F.when(F.weekday(window_end) == 0, F.expr("interval 72 hours")).otherwise(F.expr("interval 24 hours"))
    value = T.first_value(F.col("date"), F.col("collectedAt"))
    return named.orderBy(F.desc("date"), F.desc("collectedAt"), "id").limit(cap).withColumn("fresh", W.in_window(value, start, window_end))


def detail_items(pages: DataFrame, paths: Sequence[str], junk: Sequence[str], today: Column, generic: Sequence[str] = ()) -> DataFrame:
    """Items from fetched detail pages: id, sourceId, source, title, date, url, summary, contentOrigin, contentQuality.

    pages: sourceId, source, url, html, listTitle, listText, attachment, preferred. The title is the first that says
    something of the page's heading, its card, the list's and its own; the date is the first in the page or the list; the
    summary is the best of the selected nodes, or the attachment."""
    bare = lambda c: F.regexp_replace(nodes.unescaped(F.regexp_replace(c, r"(?s)<[^>]*>", " ")), r"(?U)\s+", " ")
    tag = lambda name: bare(F.regexp_extract("html", rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1))
    card = nodes.unescaped(F.regexp_extract("html", r'(?is)<meta\s[^>]*property="og:title"[^>]*content="([^"]*)"', 1))
    title = first_title(F.array(tag("h1"), card, tag("h2"), F.coalesce("listTitle", F.lit("")), tag("title")), generic, "제목 없음")
    page = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>", " ")
    rows = pages.withColumns({"title": F.substring(title, 1, B.MOST_TITLE), "date": any_date(F.concat_ws(" ", bare(page), "listText"), today)})
    best = nodes.best_text(pages, "url", "html", paths, T.quality_score(F.col("text"), F.lit("")), junk).select("url", F.col("text").alias("_node"))
    rows = rows.join(best, "url", "left").withColumn("_s", B.chosen_summary(F.col("title"), F.col("_node"), F.col("attachment"), F.coalesce("preferred", F.lit(False))))
    quality = T.quality_score(F.col("_s.summary"), F.col("title"))
    return rows.select(T.stable_id(F.col("sourceId"), F.col("url")).alias("id"), "sourceId", "source", "title", "date", "url", "_s.summary", F.col("_s.origin").alias("contentOrigin"), quality.alias("contentQuality"))


def selected(items: DataFrame, drop: Sequence[tuple[str, Column]], rules: dict[str, Sequence[str]], level: Column, importance: Column) -> tuple[DataFrame, DataFrame]:
    """Rule-based selection: the kept items with category and calibrated importance, and counts per category.

    drop: guards by name in order; level and importance: expressions over the item."""
    rows = C.guarded(items.withColumn("decision", F.lit("KEEP")), *drop)
    text = F.lower(F.concat_ws(" ", F.lit(""), "title", "summary", F.lit("")))
    category, hits = C.first_category(text, rules, "other")
    kept = rows.where("decision = 'KEEP'").withColumn("_level", level).withColumn("_score", importance)
    value, own, changed = C.calibrated(F.col("_score"), F.col("_level"), F.lit(False), F.lit(False))
    kept = kept.select(*items.columns, category.alias("category"), F.slice(hits, 1, 5).alias("keywords"), own.alias("changeLevel"), value.alias("importance"), changed.alias("adjusted"))
    return kept, kept.groupBy("category").agg(F.count("*").alias("n"))


#: So many tokens of titles make a block, on average: a week with more of them, or a token in more titles, is dealt to several.
HOT_TOKEN = 131_072
#: In place of a week: articles without a date, which meet all releases with one, and releases without a date, which meet all articles.
NO_ARTICLE_DATE, NO_RELEASE_DATE = -(1 << 31), -(1 << 31) + 1


def _candidates(r: DataFrame, a: DataFrame, before: int, after: int, least_hits: int) -> DataFrame:
    """g, newsId, seq, score, gap: each article's best release of each block of releases that it meets.

    Articles (g, ad, here, at) are in the week of their date, releases (newsId, seq, rd, rt) in the weeks that their band
    touches. A week's articles and releases are dealt into blocks of bounded expected size, each pair of which is one group."""
    week = lambda day: F.floor(day / 7).cast("int")
    no_article, no_release = F.lit(NO_ARTICLE_DATE), F.lit(NO_RELEASE_DATE)
    rd, ad = F.unix_date("rd"), F.unix_date("ad")
    r = r.withColumn("week", F.explode(F.when(rd.isNull(), F.array(no_release)).otherwise(F.concat(F.sequence(week(rd - before), week(rd + after)), F.array(no_article)))))
    a = a.withColumn("week", F.explode(F.array(F.coalesce(week(ad), no_article), no_release)))
    parts = lambda df, tokens, name: df.groupBy("week").agg(F.ceil(F.sum(F.size(tokens)) / HOT_TOKEN).cast("int").alias(name))
    weeks = parts(r, "rt", "chunks").join(parts(a, "at", "blocks"), "week").checkpoint()
    pairs = weeks.agg(F.sum(F.col("chunks").cast("long") * F.col("blocks")).alias("n")).first()["n"] or 1
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = F.broadcast(weeks)  # as many rows as the calendar has weeks at most
    left = r.join(few, "week").withColumn("chunk", dealt("newsId", F.col("chunks"))).select("newsId", "seq", "rd", "rt", "week", "chunk", each("blocks").alias("block"))
    right = a.join(few, "week").withColumn("block", dealt("g", F.col("blocks"))).select("g", "ad", "here", "at", "week", "block", each("chunks").alias("chunk"))
    keys = ("week", "block", "chunk")
    # a block is work for seconds and has few bytes: tasks go by blocks, not by their bytes, and are more, so that few get two
    left, right = (df.repartition(min(3 * int(pairs), 10_000), *keys).groupBy(*keys) for df in (left, right))
    schema = f"g binary, newsId {r.schema['newsId'].dataType.simpleString()}, seq bigint, score double, gap int"
    return left.cogroup(right).applyInArrow(lambda x, y: blocks.best_releases(x, y, before, after, least_hits), schema)


def assigned(releases: DataFrame, articles: DataFrame, region: Sequence[str] = (), other: Sequence[str] = (), before: int = 4, after: int = 14, suffixes: Sequence[str] = (), stop_words: Sequence[str] = (), least_hits: int = 0) -> DataFrame:
    """newsId, url, score, gap: each article's one release.

    releases: newsId, seq, title, date; articles: url, title, publisher, publishedAt (a date or null), seq (the order in
    which they were seen: the first row of an address counts). least_hits: so many tokens must be met where a score is
    not trusted by itself.

    Releases of equal tokens and date are one, the first of them, and so are articles (g) until the end. They meet in
    blocks by week, where hits are counted; what leaves a block is one release an article at most, so no pair is shuffled."""
    checkpointing(releases.sparkSession)
    tokens = lambda: F.array_sort(M.tokens(F.col("title"), suffixes, stop_words))
    r = releases.select("newsId", F.coalesce(F.col("seq").cast("long"), F.lit((1 << 63) - 1)).alias("seq"), F.to_date("date").alias("rd"), tokens().alias("rt")).where(F.size("rt") > 0)
    r = r.groupBy("rd", "rt").agg(F.min_by("newsId", "seq").alias("newsId"), F.min("seq").alias("seq")).checkpoint()
    a = articles.groupBy("url").agg(F.min_by(F.struct("title", "publisher", "publishedAt"), "seq").alias("x")).select("url", "x.*")
    a = a.where(~(T.any_phrase(F.col("title"), other) & ~T.any_phrase(F.col("title"), region)))  # another region is the subject of the title
    here = F.coalesce(T.any_phrase(F.concat_ws(" ", "title", "publisher"), region), F.lit(False))
    a = a.select("url", F.to_date("publishedAt").alias("ad"), tokens().alias("at"), here.alias("here"), F.coalesce(other_office(F.col("title"), region), F.lit(False)).alias("office"))
    a = a.where(~F.col("office") & (F.size("at") > 0)).drop("office")
    same = F.concat_ws("|", F.array_join("at", " "), F.coalesce(F.col("ad").cast("string"), F.lit("")), F.col("here").cast("string"))
    a = a.withColumn("g", F.unhex(F.sha2(same, 256))).checkpoint()
    found = _candidates(r, a.select("g", "ad", "here", "at").distinct().checkpoint(), before, after, least_hits)
    rank = F.struct("score", (-F.coalesce("gap", F.lit(M.NO_GAP))).alias("near"), (-F.col("seq")).alias("first"))
    best = found.groupBy("g").agg(F.max_by(F.struct("newsId", "score", "gap"), rank).alias("b"))
    return a.select("g", "url").join(best, "g").select("b.newsId", "url", "b.score", "b.gap")


def covered(releases: DataFrame, matches: DataFrame, articles: DataFrame, most: int = 30) -> DataFrame:
    """newsId, department, articleCount (before the cut) and articles: one of each publisher and title, direct addresses
    before aggregators, by date and publisher."""
    publisher = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("publisher", F.lit("")), r"(?Ui)\s*on\s+MSN\s*$", ""), r"(?U)\s+", ""))
    indirect = F.rlike(T.url_host(F.col("url")), F.lit(r"news\.google\.com|msn\.com|bing\.com")).cast("int")
    first = articles.groupBy("url").agg(F.min("seq").alias("seq"), F.min_by(F.struct("title", "publisher", "publishedAt"), "seq").alias("x")).select("url", "seq", "x.*")
    rows = matches.join(first, "url").withColumn("_p", publisher).withColumn("_t", F.regexp_replace(F.coalesce("title", F.lit("")), "[^0-9A-Za-z가-힣]", ""))
    best = rows.groupBy("newsId", "_p", "_t").agg(F.min_by(F.struct("title", "publisher", "publishedAt", "url"), F.struct(indirect, F.col("seq"))).alias("x"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("x.publishedAt", F.lit("")).alias("d"), F.coalesce("x.publisher", F.lit("")).alias("p"), "x")))
    found = best.groupBy("newsId").agg(F.count("*").alias("articleCount"), F.slice(F.transform(order, lambda y: y["x"]), 1, most).alias("articles"))
    return releases.join(found, "newsId", "left").withColumn("articleCount", F.coalesce("articleCount", F.lit(0)))


def routine_clusters(items: DataFrame, words: Column, least: int = 3, shared: int = 2, ceiling: int = 3) -> DataFrame:
    """newsId of items in clusters of `least` or more by titles that share words, none of them more important than the
    ceiling. words: an item's distinct title words."""
    found = overlap.clusters(items, "newsId", words, shared).join(items.select(F.col("newsId").alias("id"), "importance"), "id")
    groups = found.groupBy("component").agg(F.count("*").alias("n"), F.max("importance").alias("top")).where((F.col("n") >= least) & (F.col("top") <= ceiling))
    return found.join(groups.select("component"), "component", "left_semi").select(F.col("id").alias("newsId"))
