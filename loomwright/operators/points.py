"""Points of a report that say nearly the same."""

from __future__ import annotations

import difflib
import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reports import ISSUES, issue

RATIO = 0.82
#: So many texts of one group and about one length meet each other as they are.
FEW = 32


def repeated_points(points: DataFrame, group: str, index: str, text: str = "text", ratio: float = RATIO) -> DataFrame:
    """group, left, right: pairs of a group's texts (white space normalised) whose matching-blocks ratio reaches `ratio`.

    A ratio r of texts of a and b characters needs r (a + b) / 2 common characters. Counted by character, what two texts
    lack of each other is then at most (1 - r) of their length, so they share one of their rare characters' ranks: texts
    meet by (character, how many of it so far), rare ones first, with prefixes as long as that bound asks for, and not in
    all pairs. Only texts that have more than FEW others of about their length do: for the rest, that many pairs are less
    than a row for each character. The ratio itself, which no built-in function has, runs in Arrow batches over the pairs."""
    rows = points.select(F.col(group).alias("g"), F.col(index).alias("i"), F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " ")).alias("t"))
    # texts of close lengths lie in the same or in neighbouring bands; where these hold few texts of the group, all meet
    close = lambda a, b: F.lit(2.0) * F.least(a, b) / (a + b) >= ratio
    band = F.floor(F.log(F.length("t")) / (math.log((2 - ratio) / ratio) + 1e-9))
    said = rows.where("t <> ''").withColumn("n", F.length("t")).withColumn("band", band)
    around = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)]))
    many = said.select("g", around.alias("band")).groupBy("g", "band").agg(F.count("*").alias("many")).where("many > 1")
    said = said.join(many, ["g", "band"])
    sizes = said.select("g", "i", "n", "band", "many")
    few = sizes.where(F.col("many") <= FEW).withColumn("band", around)
    small = few.alias("a").join(sizes.alias("b"), ["g", "band"]).where((F.col("a.i") != F.col("b.i")) & close(F.col("a.n"), F.col("b.n")))
    small = small.select("g", F.least("a.i", "b.i").alias("left"), F.greatest("a.i", "b.i").alias("right"))
    chars = F.filter(F.split("t", ""), lambda c: c != "")
    # the k-th occurrence of a character is a token of its own
    tokens = F.transform(F.array_sort(chars), lambda c, k: F.struct(c.alias("c"), k.alias("k")))
    own = said.where(F.col("many") > FEW).select("g", "i", "n", F.explode(tokens).alias("x")).select("g", "i", "n", "x.c", "x.k")
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("g", "i", "c").orderBy("k")))
    # of two texts with n1 <= n2 characters, at least ceil(r (n1 + n2) / 2) >= ceil(r n1) tokens are shared
    often = own.groupBy("c", "k").agg(F.count("*").alias("often"))
    ranked = own.join(often, ["c", "k"]).withColumn("place", F.row_number().over(Window.partitionBy("g", "i").orderBy("often", "c", "k")))
    # the longer text's needed overlap: r (n1 + n2) / 2 with n1 >= n2 r / (2 - r)
    least = F.ceil(F.lit(ratio) * F.col("n") / (2 - F.lit(ratio)) - 1e-9)
    first = ranked.where(F.col("place") <= F.col("n") - least + 1).select("g", "i", "n", "c", "k")
    pairs = first.alias("a").join(first.alias("b"), ["g", "c", "k"]).where((F.col("a.i") < F.col("b.i")) & close(F.col("a.n"), F.col("b.n")))
    pairs = pairs.select("g", F.col("a.i").alias("left"), F.col("b.i").alias("right")).union(small).distinct()
    text_of = lambda side: rows.select("g", F.col("i").alias(side), F.col("t").alias(f"{side}_text"))
    both = pairs.join(text_of("left"), ["g", "left"]).join(text_of("right"), ["g", "right"])
    # blank texts are equal to each other: an empty pair has the ratio 1
    blank = rows.where("t = ''").groupBy("g").agg(F.array_sort(F.collect_list("i")).alias("all")).where(F.size("all") > 1)
    empty = blank.select("g", F.explode(F.flatten(F.transform("all", lambda a, k: F.transform(F.slice("all", k + 2, F.size("all")), lambda b: F.struct(a.alias("left"), b.alias("right")))))).alias("p")).select("g", "p.left", "p.right")
    found = both.where(_ratio(F.col("left_text"), F.col("right_text"), ratio) >= ratio).select("g", "left", "right").unionByName(empty)
    return found.select(F.col("g").alias(group), "left", "right")


def _ratio(a: Column, b: Column, least: float) -> Column:
    """The ratio of two texts; 0 if the characters that they have in common already rule out `least`."""

    def of(x: str, y: str) -> float:
        m = difflib.SequenceMatcher(None, x, y)
        return m.ratio() if m.quick_ratio() >= least else 0.0

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([of(x, y) for x, y in zip(a, b)], dtype=float)

    return run(a, b)


def with_repeats(items: DataFrame, key: str, sections: Sequence[str], issues: str = "issues") -> DataFrame:
    """items with DUPLICATE issues after their own: for each pair of a section's points that say nearly the same, one at the
    later point. key: one row each; sections: columns of points; issues: as functions.reports has them."""
    each = [items.select(F.struct(F.col(key).alias("key"), F.lit(c).alias("field")).alias("part"), F.posexplode(c).alias("i", "text")) for c in sections]
    points = reduce(DataFrame.unionByName, each)
    found = repeated_points(points, "part", "i").select(F.col("part.key").alias(key), issue(F.col("part.field"), F.col("right"), "DUPLICATE").alias("x"), "left")
    # in the order of sections and points; a group is one item's issues
    order = F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*[F.lit(c) for c in sections]), F.col("x.field")).alias("s"), F.col("left").alias("l"), F.col("x.pointIndex").alias("r"), "x"))), lambda y: y["x"])
    more = found.groupBy(key).agg(order.alias("_more"))
    return items.join(more, key, "left").withColumn(issues, F.concat(issues, F.coalesce("_more", F.array().cast(ISSUES)))).drop("_more")
