"""Title tokens, similarity and the decision whether an article covers a release."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import once

NEAR_DAYS = 4
NEAR_MIN_SCORE = 0.22
NEAR_TRUST_SCORE = 0.6
STRONG_MATCH_SCORE = 0.7
NO_GAP = 99


def tokens(text: Column, suffixes: Sequence[str] = (), stop_words: Sequence[str] = ()) -> Column:
    """Distinct tokens of two characters or more that are no stop words and not all digits, without their particle.

    suffixes: in the order in which they are tried; one is taken off if two characters or more stay."""
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^0-9A-Za-z가-힣\s]", " ")
    words = F.split(cleaned, r"(?U)\s+")
    if suffixes:
        pattern = "^(.{2,}?)(?:" + "|".join(suffixes) + ")$"
        words = F.transform(words, lambda w: F.regexp_replace(w, pattern, "$1"))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.rlike(w, F.lit(r"^\d+$")) & ~w.isin(list(stop_words) or [""])))


def similarity(release: Column, article: Column) -> Column:
    """The share of the release's tokens that contain, or are contained in, a token of the article.

    Both are computed once for a row. A token that is contained in another is found in the text of all of them (tokens have
    no blanks), so that only those that lie in the other side's tokens are looked for one by one."""
    within = lambda some, others: once(F.array_join(others, " "), lambda text: F.filter(some, lambda t: F.contains(text, t)))

    def share(r: Column, a: Column) -> Column:
        hit = lambda text, inner: F.filter(r, lambda t: F.contains(text, t) | F.exists(inner, lambda o: F.contains(t, o)))
        hits = once(F.array_join(a, " "), lambda text: once(within(a, r), lambda inner: hit(text, inner)))
        return F.when((F.size(r) > 0) & (F.size(a) > 0), F.size(hits) / F.size(r)).otherwise(F.lit(0.0))

    return once(release, lambda r: once(article, lambda a: share(r, a)))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def within_days(article: Column, release: Column, before: int = 4, after: int = 14) -> Column:
    """Whether the article's date lies in the release's band; an article without one does."""
    return article.isNull() | article.between(F.date_sub(release, before), F.date_add(release, after)) | release.isNull()


def same_case(score: Column, gap: Column, region: Column, other_region: Column, other_office: Column, least_hits: int = 0, hits: Column | None = None) -> Column:
    """Near in time a weak score is enough if the region is named; far in time the titles must be almost equal."""
    near = F.when(score < NEAR_MIN_SCORE, False).when(score >= NEAR_TRUST_SCORE, True)
    if least_hits and hits is not None:
        near = near.when(hits < least_hits, False)
    return F.when(other_region & ~region, False).when(other_office, False).when(gap <= NEAR_DAYS, near.otherwise(region)).otherwise(score >= STRONG_MATCH_SCORE)


def adjacent_pairs(tokens: Column) -> Column:
    """The distinct pairs of adjacent characters of an array of tokens; a token contained in another has only pairs of it."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))))


def best_by_title(releases: DataFrame, articles: DataFrame, least: float) -> DataFrame:
    """url, id, score: each article's best release (id, rt) by the similarity of their tokens (url, at), the first of equals.

    A score of `least` needs so many of a release's tokens to be met; of each release's tokens the rarest ones, of which
    one at least must then be met, give the pairs of characters by which it meets articles: frequent words join nothing."""
    words = releases.select("id", F.size("rt").alias("n"), F.explode("rt").alias("w"))
    often = articles.select(F.explode("at").alias("w")).groupBy("w").agg(F.count("*").alias("often"))
    ranked = words.join(often, "w", "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "w"))).alias("ws"))
    # without n - ceil(least n) + 1 of its tokens a release cannot reach the score
    rare = ranked.select("id", F.slice("ws", 1, F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int") + 1).alias("ws"))
    keyed = rare.select("id", F.explode(adjacent_pairs(F.transform("ws", lambda x: x["w"]))).alias("p"))
    met = articles.select("url", F.explode(adjacent_pairs(F.col("at"))).alias("p")).join(keyed, "p").select("url", "id").distinct()
    score = met.join(articles, "url").join(releases, "id").select("url", "id", similarity(F.col("rt"), F.col("at")).alias("score")).where(F.col("score") >= least)
    return score.groupBy("url").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("x")).select("url", "x.id", "x.score")
