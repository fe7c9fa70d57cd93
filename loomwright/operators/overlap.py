"""Rows that have words in common, without meeting all rows of a word."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import components


def _combinations(words: Column, size: int) -> Column:
    """All sets of `size` of an array's words, each in the array's order."""
    start = F.transform(words, lambda w, i: F.struct(F.array(w).alias("ws"), i.alias("at")))
    for _ in range(size - 1):
        longer = lambda c: F.transform(F.slice(words, c["at"] + 2, F.size(words)), lambda w, i: F.struct(F.concat(c["ws"], F.array(w)).alias("ws"), (c["at"] + i + 1).alias("at")))
        start = F.flatten(F.transform(start, longer))
    return F.transform(start, lambda c: c["ws"])


def clusters(items: DataFrame, key: str, words: Column, shared: int = 2) -> DataFrame:
    """id, component (its smallest id): items that have `shared` words in common, and what these lead to.

    All items that have the same `shared` words belong together, so each is linked with the first of them only: there are
    as many links as sets of so many words in the items, however many items a word or a set is in. Words that only one
    item has are left out before. Meant for titles: sets grow with a text's words to the power `shared`."""
    rows = items.select(F.col(key).alias("id"), F.explode(F.array_distinct(words)).alias("w"))
    common = rows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    kept = rows.join(common, "w").groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    sets = kept.select("id", F.explode(_combinations(F.col("ws"), shared)).alias("set"))
    first = sets.groupBy("set").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last")).drop("last")
    links = sets.join(first, "set").where(F.col("id") > F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    return components(links)


def needed(n: Column, least: float, hits: int = 1, trusted: float = 1.0) -> Column:
    """How many of n tokens must be met for a share of `least`, or (with `hits`) for so many of them unless the share
    reaches `trusted`."""
    at_least = lambda share: F.greatest(F.ceil(F.lit(share) * n - F.lit(1e-9)).cast("int"), F.lit(1))
    return F.greatest(at_least(least), F.least(F.lit(hits), at_least(trusted)))


def _substrings(token: Column, longest: int) -> Column:
    """A token's distinct substrings of two characters or more, up to a length."""
    ends = lambda i: F.sequence(F.lit(2), F.least(F.length(token) - i + 1, F.lit(longest)))
    starts = F.sequence(F.lit(1), F.length(token) - 1)
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda n: F.substring(token, i, n)))))


def _adjacent(token: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2))))


#: Tokens up to this length meet by their substrings, longer ones (no words of a language) by pairs of characters.
LONGEST_WORD = 24


def containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r: distinct tokens (column t, two characters or more) of two tables of which one contains the other.

    Each side is the vocabulary, not the texts. The contained token equals one of the other's substrings, so both joins
    are equalities that make only true pairs; tokens too long for that meet by a pair of characters and are tested."""
    short = lambda df: df.where(F.length("t") <= LONGEST_WORD)
    into = lambda df: short(df).select("t", F.explode(_substrings(F.col("t"), LONGEST_WORD)).alias("s"))
    a = short(left).select(F.col("t").alias("l"), F.col("t").alias("s")).join(into(right).withColumnRenamed("t", "r"), "s").select("l", "r")
    b = into(left).withColumnRenamed("t", "l").join(short(right).select(F.col("t").alias("r"), F.col("t").alias("s")), "s").select("l", "r")
    pairs = lambda df, name: df.select(F.col("t").alias(name), F.explode(_adjacent(F.col("t"))).alias("p"))
    long = lambda df: df.where(F.length("t") > LONGEST_WORD)
    tested = pairs(long(left), "l").join(pairs(right, "r"), "p").unionByName(pairs(short(left), "l").join(pairs(long(right), "r"), "p"))
    tested = tested.select("l", "r").distinct().where(F.contains("l", F.col("r")) | F.contains("r", F.col("l")))
    return a.union(b).union(tested).distinct()


#: Values are sorted within bands of this width; one band of one group has at most a hundred times as many values of two decimals.
BAND = 50.0


def nearest(left: DataFrame, right: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """url, id, score: for each row of left (url, k, v) that of right (id, k, v) with its k and the best score, the smallest
    id of equals; NaN is the greatest.

    Values have two decimals at most, and a score never rises with their distance; it may be equal for values that are
    0.01 apart, not for three in a row. So the best is the next value on either side or the one behind it. Next values come
    from sorting distinct values within bands; what no band of its own has comes from the ends of the other bands."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    at = right.where("v is not null").groupBy("k", "v").agg(F.min("id").alias("id")).withColumn("v", F.col("v") + F.lit(0.0))
    own = F.struct("v", "id")
    cents = F.floor(F.least(F.greatest(F.col("v") * 100 + 0.5, F.lit(-1e17)), F.lit(1e17)))
    steps = at.where(finite(F.col("v"))).withColumn("x", own)
    # each value with its neighbours 0.01 away: what can be its equal by score
    around = steps.select("k", "x", F.explode(F.array(cents - 1, cents, cents + 1)).alias("cents")).groupBy("k", "cents").agg(F.collect_set("x").alias("xs"))
    known = steps.withColumn("cents", cents).join(around, ["k", "cents"]).select("k", "v", "xs")
    asked = left.where("v is not null").select("k", "v").distinct().where(finite(F.col("v")))
    points = known.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True).withColumn("band", F.floor(F.col("v") / BAND))
    ends = points.where(~F.col("asks")).groupBy("k", "band").agg(F.min_by("xs", "v").alias("first"), F.max_by("xs", "v").alias("last"))
    bands = points.select("k", "band").distinct().join(ends, ["k", "band"], "left")
    order = Window.partitionBy("k").orderBy("band")
    bands = bands.select("k", "band", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("lower"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("upper"))
    # a value is its own lower neighbour: releases come first
    inside = Window.partitionBy("k", "band").orderBy("v", "asks")
    beside = points.select("k", "v", "asks", "band", F.last("xs", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("below"), F.first("xs", True).over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("above")).where("asks")
    none = F.array().cast("array<struct<v:double,id:bigint>>")
    met = beside.join(bands, ["k", "band"]).select("k", "v", F.concat(F.coalesce("below", "lower", none), F.coalesce("above", "upper", none)).alias("xs"))
    rank = F.transform("xs", lambda x: F.struct(score(x["v"], F.col("v")).alias("score"), (-x["id"]).alias("first")))
    best = met.select("k", "v", F.array_max(rank).alias("b"))
    # values without end or number: a score of NaN is that of any with NaN, and of equal infinite ones
    odd = at.groupBy("k").agg(F.min("id").alias("any"), F.min(F.when(F.isnan("v"), F.col("id"))).alias("nan"), *[F.min(F.when(F.col("v") == x, F.col("id"))).alias(n) for n, x in (("up", float("inf")), ("down", float("-inf")))])
    special = F.when(F.isnan("v"), F.col("any")).otherwise(F.least("nan", F.when(F.col("v") == float("inf"), F.col("up")).when(F.col("v") == float("-inf"), F.col("down"))))
    rows = left.where("v is not null").join(best, ["k", "v"], "left").join(odd, "k").withColumn("_s", special)
    some = F.col("_s").isNotNull()
    return rows.select("url", F.when(some, F.col("_s")).otherwise(-F.col("b.first")).alias("id"), F.when(some, float("nan")).otherwise(F.col("b.score")).alias("score")).where("id is not null")
