"""Text of selected elements of pages, by a structural join.

A page becomes rows, one for each tag and each text between tags, in page order. How many elements of a kind are open at a
row is a running sum: +1 at a start tag, -1 at an end tag. An element's interval ends at the first later end tag of its
name at its depth; a row is inside an element if its place lies within the interval. A path such as "main p" is a chain of
such intervals, and text within junk elements is left out the same way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bodies import clean_lines

# --- fixed values: elements without an end tag or with one that may be left out, characters by name ----------------------
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
OPTIONAL = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
NAMED = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&"))
# -------------------------------------------------------------------------------------------------------------------
#: A comment, a whole script or style, a tag, or text between them.
_PIECE = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)|<[/!?a-z][^>]*>|[^<]+|<"
_ATTRIBUTE = r"""(?is)\s{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def unescaped(text: Column) -> Column:
    """Named and numbered characters as they are."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[xX][0-9a-fA-F]{1,6}|\d{1,7});"), F.lit(0)))

    def plain(code: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(code, r"[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("int")
        n = F.coalesce(hexadecimal, F.regexp_extract(code, r"&#(\d+);", 1).try_cast("int"))
        # a code point as four bytes, which decode() reads in any plane
        return F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("�"))

    out = F.aggregate(codes, text, lambda t, c: F.replace(t, c, plain(c)))
    for name, char in NAMED:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def _attribute(tag: Column, name: str) -> Column:
    found = [F.regexp_extract(tag, _ATTRIBUTE.format(name), i) for i in (1, 2, 3)]
    return F.concat(*found)


def pieces(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, name, step (+1 start, -1 end, 0 text), classes, id, text: the tags and texts of each page in order."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_PIECE), F.lit(0))).alias("at", "raw"))
    raw = F.col("raw")
    tag = F.rlike(raw, F.lit(r"(?i)\A</?[a-z]")) & ~F.rlike(raw, F.lit(r"(?i)\A<(?:script|style)\b"))
    name = F.lower(F.regexp_extract(raw, r"(?i)\A</?([a-z][a-z0-9-]*)", 1))
    ended = F.rlike(raw, F.lit(r"/\s*>\z")) | name.isin(*VOID)
    step = F.when(~tag, 0).when(F.startswith(raw, F.lit("</")), F.when(name.isin(*VOID), 0).otherwise(-1)).when(ended, 0).otherwise(1)
    text = F.when(~tag & ~F.startswith(raw, F.lit("<!")) & ~F.rlike(raw, F.lit(r"(?i)\A<(?:\?|script|style)")), raw)
    return rows.select(key, "at", F.when(tag, name).alias("name"), step.alias("step"), F.when(tag, _attribute(raw, "class")).alias("classes"), F.when(tag, _attribute(raw, "id")).alias("id"), text.alias("text"))


def matches(selector: str) -> Column:
    """Whether a row of pieces() is an element of a simple selector: name, .class, #id, or a name with one of them."""
    name, dot, css = selector.partition(".")
    name, hash_, own = (name, "", "") if dot else selector.partition("#")
    test = F.col("name").isNotNull()
    if name:
        test = test & (F.col("name") == name.lower())
    if dot:
        test = test & F.array_contains(F.split(F.coalesce("classes", F.lit("")), r"\s+"), css)
    if hash_:
        test = test & (F.col("id") == own)
    return test


def elements(rows: DataFrame, key: str, selector: str) -> DataFrame:
    """key, begin, end: the intervals of a selector's elements.

    One without an end tag ends where the innermost closed element around it does, or at its page's end; a paragraph, list
    item or cell also where the next one begins."""
    w = Window.partitionBy(key, "name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # a start tag stands at the depth that it opens, an end tag at the depth that it closes
    depth = F.sum("step").over(w) + F.when(F.col("step") < 0, 1).otherwise(0)
    tags = rows.where("step <> 0").withColumn("depth", depth)
    later = Window.partitionBy(key, "name", "depth").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    following = Window.partitionBy(key, "name").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    end = F.first(F.when(F.col("step") < 0, F.col("at")), ignorenulls=True).over(later)
    again = F.when(F.col("name").isin(*OPTIONAL), F.first(F.when(F.col("step") > 0, F.col("at")), ignorenulls=True).over(following))
    spans = tags.withColumns({"end": end, "again": again}).where("step > 0")
    found = spans.where(matches(selector)).select(key, F.col("at").alias("begin"), "end", "again")
    closed = spans.where("end is not null").select(key, F.col("at").alias("_b"), F.col("end").alias("_e"))
    open_ = found.where("end is null").join(closed, key, "left").groupBy(key, "begin", "again").agg(F.min(F.when(F.col("begin").between(F.col("_b"), F.col("_e")), F.col("_e"))).alias("around"))
    ended = open_.select(key, "begin", F.least(F.coalesce("again", "around", F.lit(2**31 - 1)), F.coalesce("around", F.lit(2**31 - 1))).alias("end"))
    return found.where("end is not null").select(key, "begin", "end").unionByName(ended)


def _outermost(intervals: DataFrame, key: str) -> DataFrame:
    """Intervals that lie in no other one."""
    w = Window.partitionBy(key).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("reach", F.max("end").over(w)).where(F.col("reach").isNull() | (F.col("reach") <= F.col("begin"))).drop("reach")


def selected(rows: DataFrame, key: str, path: str) -> DataFrame:
    """key, begin, end: the outermost elements of a path of simple selectors, each within the one before it."""
    found = None
    for selector in path.split():
        step = elements(rows, key, selector)
        if found is not None:
            outer = _outermost(found, key).select(key, F.col("begin").alias("_b"), F.col("end").alias("_e"))
            step = step.join(outer, key).where((F.col("begin") > F.col("_b")) & (F.col("begin") < F.col("_e"))).drop("_b", "_e")
        found = step
    return _outermost(found, key)


def node_texts(pages: DataFrame, key: str, html: str, path: str, junk: Sequence[str] = (), first_only: bool = True) -> DataFrame:
    """key, begin, text: clean lines of each selected element (or the first of a page) without its junk elements."""
    rows = pieces(pages, key, html)
    found = selected(rows, key, path)
    if first_only:
        found = found.groupBy(key).agg(F.min_by(F.struct("begin", "end"), "begin").alias("x")).select(key, "x.*")
    texts = rows.where("text is not null").select(key, "at", "text").join(found, key).where((F.col("at") > F.col("begin")) & (F.col("at") < F.col("end")))
    for selector in junk:
        bad = _outermost(elements(rows, key, selector), key).select(key, F.col("begin").alias("_b"), F.col("end").alias("_e"))
        texts = texts.alias("t").join(bad.alias("j"), (F.col(f"t.{key}") == F.col(f"j.{key}")) & F.col("at").between(F.col("_b"), F.col("_e")), "left_anti")
    lines = F.array_sort(F.collect_list(F.struct("at", "text")))
    joined = texts.groupBy(key, "begin").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
    return joined.select(key, "begin", clean_lines(unescaped(F.col("text"))).alias("text"))


def best_text(pages: DataFrame, key: str, html: str, paths: Sequence[str], score: Column, junk: Sequence[str] = ()) -> DataFrame:
    """key, path, text: of the first element of each path, the text of the highest score (over column text); of equals,
    that of the path named first. Pages without any have no row."""
    found = None
    for i, path in enumerate(paths):
        one = node_texts(pages, key, html, path, junk).select(key, F.lit(i).alias("i"), F.lit(path).alias("path"), "text").where("text <> ''")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(key).agg(F.max_by(F.struct("path", "text"), F.struct(score.alias("score"), (-F.col("i")).alias("first"))).alias("x"))
    return best.select(key, "x.path", "x.text")
