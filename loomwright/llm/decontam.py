"""Benchmark decontamination by template windows, in DataFrame expressions only.

A text is looked at in two views. Its words as they are: windows of WINDOW words find what was copied, in whatever case.
Its template: numbers, names (runs of capitalised words) and units after numbers become typed placeholders; windows of
which PLAIN are words find questions with other numbers, names and units. An item without any such window, mostly
numbers, is looked for by windows with a word at least and a name at most, all of which a document must have. Windows are
hashed and joined with the benchmark's. Hits on one diagonal of one view (document position minus item position) are one occurrence of a passage.
Within each run of contiguous hits of templates the slots must be consistent: one benchmark value always stands for one
value of the document, while two values may stand for the same one; of a run that is not, the windows with equal tokens
count. So a question with other numbers is caught, and a text that merely has numbers is not.
Windows that many items have, such as a line of instructions, are no sign of one of them: an item counts by its others.

Defined results: null texts have no tokens; items shorter than WINDOW tokens are one window of their own length, items
of fewer than SHORTEST tokens are not looked for; repeated items are found each; repeated rows of a document are found
once; rows are told apart by id and text, so that null and repeated ids keep their own results; texts of any length are
read whole; further columns of docs are kept by decontaminated() and ignored by contaminated().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

WINDOW = 8
SHORTEST = 4
#: Windows on one diagonal that make an occurrence (or all windows of an item that has fewer).
HITS = 3
#: A window that more different texts of the benchmark have is looked for only where an item has no other.
COMMON = 8
#: A template's window with a smaller share of plain words is thin.
PLAIN = 0.6
#: Words and names of an item that is looked for by thin windows; one with fewer, one shorter than a window, and one with
#: windows of numbers or names alone would be found anywhere, and are left to the view of words.
FEWEST = 2
#: Benchmark windows, and rows of ids, that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
UNITS = "km|cm|mm|kg|mg|lb|lbs|oz|ml|mi|ft|mph|kmh|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|meters?|metres?|miles?|feet|inches|grams?|liters?|litres?|dollars?|euros?|cents?|percent"
NAME, UNIT, NUMBER = 1, 2, 3
TOKEN = r"[\p{L}\p{M}]+|\x01[\p{L}\p{M}]+|(?<=[\p{L}\p{M}])[ \t]\x01[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*|\x03[\p{L}\p{M}]+"
WORDS, TEMPLATE = 0, 1


def tokens(text: Column) -> Column:
    """Words and numbers in lower case; \\x01 precedes a capitalised word, with a space before it one that directly follows a
    word, \\x03 a unit after a number."""
    named = F.regexp_replace(text, r"(?<![\p{L}\p{M}])(?=\p{Lu})", "\u0001")
    united = F.regexp_replace(named, rf"(?<=\p{{N}})[ \t]?({UNITS})\b", "\u0003$1")
    return F.regexp_extract_all(F.lower(united), F.lit(TOKEN), F.lit(0))


def _continues(words: Column, i: Column) -> Column:
    """Whether a token is a further word of the name before it."""
    return (i > 0) & (F.get(words, i) < "!") & (F.get(words, i) >= "\t") & ((F.get(words, i - 1) < "\u0003") | (F.get(words, i - 1) < "!") & (F.get(words, i - 1) >= "\t"))


def plain_words(words: Column) -> Column:
    """The tokens without their marks."""
    return F.transform(words, lambda w: F.ltrim(w, F.lit("\u0001\u0003 \t")))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, however often, and in whatever lambda, f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def template(words: Column) -> Column:
    """The tokens of the template, a name of several words being one token."""

    def joined(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: ~F.coalesce(_continues(words, i), F.lit(False)))
        return _let(starts, lambda at: F.transform(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, k: F.array_join(F.slice(words, a + 1, F.get(at, k + 1) - a), " ")))

    return _let(words, joined)


def codes(words: Column) -> Column:
    """A number for each token of the template: a word's hash, or a placeholder."""
    own = _let(words, lambda words: F.filter(words, lambda w, i: ~_continues(words, i)))
    return F.transform(own, lambda w: F.when(w >= ":", F.xxhash64(w)).when(w < "\u0003", F.lit(NAME).cast("long")).when(w < "\u0004", F.lit(UNIT).cast("long")).otherwise(F.lit(NUMBER).cast("long")))


def _spans(values: Column, size: int, join: Callable[[Column, Column], Column]) -> Column:
    """Of an array, join over each `size` consecutive values by position: spans of 1, 2, 4, ... values are joined once each,
    and those that make up `size` are put together."""

    def grown(spans: list[Column], rest: int) -> Column:
        if 2 ** len(spans) <= rest:
            width = 2 ** (len(spans) - 1)
            return _let(F.zip_with(spans[-1], F.slice(spans[-1], width + 1, F.size(spans[-1])), join), lambda x: grown([*spans, x], rest))
        out, covered = None, 0
        for k in reversed(range(len(spans))):
            if rest - covered >= 2**k:
                out = spans[k] if out is None else F.zip_with(out, F.slice(spans[k], covered + 1, F.size(spans[k])), join)
                covered += 2**k
        return F.slice(out, 1, F.greatest(F.size(values) - size + 1, F.lit(0)))

    return _let(values, lambda x: grown([x], size))


def windows(code: Column, size: int, view: int) -> Column:
    """The hash of each window by position, odd for thin ones; null where a template's window has too few plain words."""

    def hashed(code: Column) -> Column:
        own = _spans(code, size, lambda a, b: F.xxhash64(a, b))
        if view == WORDS:
            return own
        # words and names of a window in one number: a name is 100
        kinds = F.transform(code, lambda c: F.when((c < NAME) | (c > NUMBER), F.lit(1)).when(c == NAME, F.lit(100)).otherwise(F.lit(0)))
        even = lambda h: F.shiftleft(F.xxhash64(h, F.lit(TEMPLATE)), 1)
        both = _spans(kinds, size, lambda a, b: a + b)
        return F.zip_with(own, both, lambda h, n: F.when(n % 100 >= PLAIN * size, even(h)).when((n % 100 > 0) & (n < 200), even(h) + 1))

    return _let(code, hashed)


def _views(df: DataFrame, key: str) -> DataFrame:
    """key, view, code: the numbers of a text's tokens in each view."""

    def both(words: Column) -> Column:
        raw = F.transform(plain_words(words), lambda w: F.xxhash64(w))
        return F.array(F.struct(F.lit(WORDS).alias("view"), raw.alias("code")), F.struct(F.lit(TEMPLATE).alias("view"), codes(words).alias("code")))

    return df.select(key, F.inline(_let(tokens(F.col("text")), both)))


def _windows(df: DataFrame, key: str, at: str, sizes: Column) -> DataFrame:
    """key, view, size, at, window: the windows of each size in an array of small structs (size, code)."""
    return df.select(key, "view", F.inline(sizes)).select(key, "view", "size", F.posexplode("hashes").alias(at, "window")).where("window is not null")


def _hashes(size: int) -> Column:
    own = F.when(F.col("view") == WORDS, windows(F.col("code"), size, WORDS)).otherwise(windows(F.col("code"), size, TEMPLATE))
    return F.struct(F.lit(size).alias("size"), own.alias("hashes"))


def thin() -> Column:
    return (F.col("view") == TEMPLATE) & (F.col("window") % 2 != 0)


def _wanted(items: DataFrame, sizes: list[int]) -> DataFrame:
    """item_id, view, size, at, window: the windows that an item is looked for by.

    A window that more than COMMON different texts of the benchmark have (an instruction, a frame of many questions) tells
    nothing of one of them: an item is looked for by its other windows, or by all of them where it has no other. Thin windows
    are those of items that have none but thin ones."""
    enough = (F.size("code") >= WINDOW) & (F.size(F.filter("code", lambda c: (c < UNIT) | (c > NUMBER))) >= FEWEST)
    own = F.filter(F.array(*[_hashes(n) for n in sizes]), lambda x: x["size"] == F.col("size"))
    whole = _windows(items, "item_id", "at", own).withColumn("thin", thin())
    needed = items.groupBy("item_id", "view").agg(F.max(F.size("code") - F.col("size") + 1).alias("places"), F.min(enough).alias("enough"))
    has = whole.join(needed, ["item_id", "view"]).groupBy("item_id", "view").agg((F.min("thin") & (F.count_distinct("at") == F.first("places")) & F.first("enough")).alias("only thin"))
    every = whole.join(has, ["item_id", "view"]).where(~F.col("thin") | F.col("only thin")).join(items.select("item_id", "view", F.xxhash64("code").alias("text")), ["item_id", "view"])
    often = every.groupBy("view", "window").agg(F.count_distinct("text").alias("n")).where(F.col("n") > COMMON).select("view", "window", F.lit(True).alias("common"))
    known = every.join(often, ["view", "window"], "left").withColumn("common", F.coalesce("common", F.lit(False)))
    alone = known.groupBy("item_id", "view").agg(F.min("common").alias("all common"))
    return known.join(alone, ["item_id", "view"]).where(~F.col("common") | F.col("all common")).select("item_id", "view", "size", "at", "window")


def _hits(texts: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """row, item_id, view, diagonal, at, size: equal windows. Texts are tokenised once for windows of all sizes."""
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = wanted.select("item_id", F.col("view").alias("own"), F.col("size").alias("width"), "at", "window")
    found = _windows(texts, "row", "place", F.array(*[_hashes(n) for n in sizes]))
    both = found.join(F.broadcast(own) if small else own, "window").where("view - own = 0 and size - width = 0")  # one number is the join's key
    return both.select("row", "item_id", "view", (F.col("place") - F.col("at")).alias("diagonal"), "at", "size")


def _bounded(ids: DataFrame) -> DataFrame:
    """Ids for a semi join or anti join that sorts no text: broadcast if there are few, else hashed in each partition."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids.hint("shuffle_hash")


def _row(docs: DataFrame, key: str = "doc_id") -> Column:
    """What tells rows apart, as ids may be null or repeated: the id, and a hash of the text."""
    return F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64("text").alias("hash"))


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, item_id, view, diagonal, begin, windows, exact: where a document (by its row's hash) has a passage of an item."""
    items = _views(benchmark.select("item_id", "text"), "item_id").where(F.size("code") >= SHORTEST).withColumn("size", F.least(F.size("code"), F.lit(WINDOW)))
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most WINDOW values
    if not sizes:
        nothing = (("item_id", "long"), ("view", "int"), ("diagonal", "int"), ("begin", "int"), ("windows", "long"), ("exact", "boolean"))
        return docs.where("false").select(_row(docs).alias("row"), *[F.lit(None).cast(t).alias(c) for c, t in nothing])
    texts = _views(docs.select(_row(docs).alias("row"), "text"), "row")
    wanted = stored(_wanted(items, sorted(sizes)), "wanted")
    found = _hits(texts, wanted, sorted(sizes)).drop("size")
    need = wanted.groupBy("item_id", "view", "size").agg(F.least(F.when(F.max(thin()), F.lit(1 << 30)).otherwise(F.lit(HITS)), F.count_distinct("at").cast("int")).alias("need"))
    one = ["row", "item_id", "view", "diagonal"]
    every = found.groupBy(*one).agg(F.array_sort(F.collect_set("at")).alias("ats")).join(need, ["item_id", "view"]).where(F.size("ats") >= F.col("need"))
    # contiguous hits: their place in the list grows as their position does
    spread = every.select(*one, "need", "size", F.posexplode("ats").alias("rank", "at"))
    islands = spread.groupBy(*one, "need", "size", (F.col("at") - F.col("rank")).alias("island")).agg(F.min("at").alias("begin"), F.max("at").alias("last"), F.count("*").alias("windows"))
    # few rows, of which two joins are made: the windows of all documents are not hashed twice
    runs = stored(islands.drop("island"), "runs")
    copied = runs.where(F.col("view") == WORDS).select(*one, "begin", "need", "windows", F.lit(True).alias("exact"))
    return _summed(copied.unionByName(_consistent(runs.where(F.col("view") == TEMPLATE), docs, benchmark)))


def _consistent(runs: DataFrame, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The runs of templates with how many windows hold once their slots are compared."""
    ids = runs.select("row").distinct()
    theirs = stored(docs.select(_row(docs).alias("row"), "text").join(_bounded(ids), "row", "left_semi").select("row", template(tokens(F.col("text"))).alias("theirs")), "templates")
    own = benchmark.select("item_id", template(tokens(F.col("text"))).alias("words"))
    both = runs.join(own, "item_id").join(theirs, "row").withColumn("span", F.sequence(F.col("begin"), F.col("last") + F.col("size") - 1))
    # the item's slots within the run, and what the document has in their places
    slots = F.filter("span", lambda i: F.get("words", i) < ":")
    both = both.withColumn("pairs", F.array_distinct(F.transform(slots, lambda i: F.struct(F.get("words", i).alias("a"), F.get("theirs", i + F.col("diagonal")).alias("b")))))
    function = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")

    def equal(acc: Column, i: Column) -> Column:
        length = F.when(F.get("words", i) == F.get("theirs", i + F.col("diagonal")), acc["length"] + 1).otherwise(F.lit(0))
        return F.struct(length.alias("length"), (acc["hits"] + (length >= F.col("size")).cast("int")).alias("hits"))

    same = F.aggregate("span", F.struct(F.lit(0).alias("length"), F.lit(0).alias("hits")), equal, lambda acc: acc["hits"])
    exact = F.forall("pairs", lambda p: p["a"] == p["b"])
    return both.select("row", "item_id", "view", "diagonal", "begin", "need", F.when(function, F.col("windows")).otherwise(same).alias("windows"), exact.alias("exact"))


def _summed(runs: DataFrame) -> DataFrame:
    """One row for each diagonal; repeated rows of a document and repeated items count once."""
    one = ["row", "item_id", "view", "diagonal"]
    each = runs.groupBy(*one, "begin", "need").agg(F.max("windows").alias("windows"), F.max("exact").alias("exact"))
    return each.groupBy(*one).agg(F.min("begin").alias("begin"), F.sum("windows").alias("windows"), F.min("exact").alias("exact"), F.first("need").alias("need")).where("windows >= need").drop("need")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document (id and text) and item with an occurrence: doc_id, item_id, windows (of the longest), exact
    (no slot has another value)."""
    found = occurrences(docs, benchmark).groupBy("row", "item_id").agg(F.max("windows").alias("windows"), F.max("exact").alias("exact"))
    return found.select(F.col("row.id").alias("doc_id"), "item_id", "windows", "exact")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no passage of the benchmark occurs."""
    found = stored(occurrences(docs, benchmark).select("row").distinct(), "contaminated")
    kept = docs.withColumn("row of text", _row(docs)).join(_bounded(found.withColumnRenamed("row", "row of text")), "row of text", "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
