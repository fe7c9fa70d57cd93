"""Bodies of releases: headers, subtitles, own summaries, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bodies as B
from .coverage import COMMON_WORDS, _titles_sql
from .registry import query, table

_SPACE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CLEAN = "array_to_string(list_filter(list_transform(string_split(replace(coalesce({}, ''), chr(13), chr(10)), chr(10)), lambda x: " + _SPACE.format("x") + "), lambda x: x <> ''), chr(10))"
_KEY = "lower(regexp_replace({}, '[^0-9A-Za-z가-힣]', '', 'g'))"


@query(f"""
with d as (select doc_id, {_CLEAN.format('text')} as t, coalesce(string_split(text, chr(10))[2], '') as title from documents),
     k as (select *, {_KEY.format('title')} as key, string_split(t, '') as chars from d),
     p as (select *, list_filter(list_transform(chars, lambda c, i: case when regexp_matches(c, '[0-9A-Za-z가-힣]') then i end), lambda i: i is not null) as places from k),
     o as (select *, case when length(key) >= 8 then string_split({_KEY.format('t')}, key) end as pieces from p),
     e as (select *, list_transform(pieces[1:len(pieces) - 1], lambda x, i: places[cast(list_sum(list_transform(pieces[1:i], lambda y: length(y))) + i * length(key) as bigint)]) as ends from o),
     r as (select *, list_filter(list_transform(ends, lambda x: {_CLEAN.format("substr(t, cast(x as bigint) + 1)")}), lambda x: length({_SPACE.format('x')}) >= 10) as rests,
           string_split(t, chr(10)) as lines from e),
     f as (select *, list_filter(list_transform(lines, lambda x, i: case when length({_KEY.format('x')}) >= greatest(8, floor(length(key) * 0.6)) and (contains({_KEY.format('x')}, key) or contains(key, {_KEY.format('x')}))
             then array_to_string(lines[i + 1:], chr(10)) end), lambda x: x is not null and length({_SPACE.format('x')}) >= 10) as after from r),
     g as (select doc_id, case when length(key) < 8 then t else coalesce(rests[len(rests)], after[1], t) end as body from f)
select doc_id, length(body) as n, md5(body) as body_md5 from g""")
def bodies_without_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document from what follows its title on; its second line is taken for the title."""
    title = F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit("]"), F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", B.without_header(F.col("text"), title).alias("body")).select("doc_id", F.length("body").cast("long").alias("n"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(f"""
with d as (select doc_id, string_split(text, chr(10)) as lines, {_titles_sql("string_split(text, chr(10))[1]")} as r from documents),
     x as (select doc_id, r, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
     c as (select doc_id, r, i, {_STRIP.format("replace(line, ' on ', '')")} as text from x where contains(line, ' on ')),
     s as (select doc_id, i, text, r, {_titles_sql("text")} as o from c where length(text) >= 8),
     m as (select doc_id, i, text, case when len(r) > 0 and len(o) > 0 then len(list_filter(r, lambda x: len(list_filter(o, lambda y: contains(y, x) or contains(x, y))) > 0)) * 1.0 / len(r) else 0.0 end as score from s)
select doc_id, text as subtitle from m where score < 0.8 qualify row_number() over (partition by doc_id order by score, i) = 1""")
def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's lines with a marker, the one least like its first line."""
    found = B.subtitle(F.col("text"), F.get(F.split("text", "\n"), F.lit(0)), " on ", stop_words=COMMON_WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("subtitle")).where("subtitle is not null")


def _latin(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^a-zA-Z]", "")) >= 10


_FRAGMENT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^[\\-–—·•*\\s]+', ''), '[\\-–—·•\\s]+$', ''), '\\s+', ' ', 'g'), '\\s+([,\\.’”\\)\\]%])', '\\1', 'g'), '([‘“\\(\\[])\\s+', '\\1', 'g'), '~\\s+(\\d)', '~\\1', 'g'))"
_SHORT = "case when length({0}) <= 140 then {0} else rtrim(substr({0}, 1, 137)) || '...' end"


@query(f"""
with d as (select doc_id, coalesce(text, '') as body, {_SPACE.format("regexp_extract(text, '^[^.!?\\n]*[.!?]?')")} as name from documents),
     f as (select *, list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(10), 'g'), '[\\n\\r]+|\\s*[◦□○▪▫■●▲△▶◆➀-➉①-⑳※▸▹‣·]\\s*'), lambda x: {_FRAGMENT.format('x')}),
             lambda x: x <> '' and x <> case when name = '' then '보도자료' else name end and length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) >= 10) as good from d),
     s as (select *, {_SHORT.format('good[1]')} as a, {_FRAGMENT.format(_SPACE.format('body'))} as whole from f),
     t as (select *, list_filter(good[2:], lambda x: x <> a)[1] as b from s)
select doc_id, case when len(good) > 0 then a when whole <> '' then {_SHORT.format('whole')} else {_SHORT.format("case when name = '' then '보도자료' else name end")} end as point_1,
  case when len(good) > 0 then {_SHORT.format('b')} end as point_2 from t""")
def own_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points of each document where no model gave any; its first sentence is the title."""
    points = B.own_summary(F.col("text"), F.regexp_extract("text", r"^[^.!?\n]*[.!?]?", 0), _latin)
    return table(spark, sf_dir, "documents").select("doc_id", points.alias("p")).select("doc_id", F.get("p", F.lit(0)).alias("point_1"), F.get("p", F.lit(1)).alias("point_2"))


WORDS, ENDINGS = ("the", "de", "der", "la"), ("tion", "er", "es", "en")
_MARKER = "(?m)^\\s*\\d{1,2}\\.\\s*"
_NAMED = " or ".join(f"contains({{0}}, '{w}')" for w in WORDS)


def _tidy(x: str) -> str:
    for pattern, to in (("\\s+([,.:;!?])", "\\1"), ("([‘“\"\\(\\[])\\s+", "\\1"), ("\\s+([’”\"\\)\\]])", "\\1"), ("\\s*·\\s*", "·"), ("\\s*,\\s*", ", ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({_SPACE.format(x)}, ' ,')"


@query(f"""
with b as (select conv_id, string_agg((turn + 1) || '. ' || coalesce(text, ''), chr(10) order by turn) as t from conversations group by 1),
     p as (select *, regexp_split_to_array(t, '{_MARKER}') as pieces, regexp_extract_all(t, '{_MARKER}') as ms from b),
     e as (select conv_id, t, ms, list_transform(ms, lambda m, i: cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) as bigint)) as ends from p),
     q as (select conv_id, t, list_filter(list_transform(ends, lambda x, i: [x - length(ms[i]), x]), lambda m: coalesce(
             length(list_filter(list_transform(string_split(substr(t, m[2] + 1, 250), chr(10)), lambda y: {_STRIP.format('y')}), lambda y: y <> '')[1]) >= 5
             and ({_NAMED.format("list_filter(list_transform(string_split(substr(t, m[2] + 1, 250), chr(10)), lambda y: " + _STRIP.format('y') + "), lambda y: y <> '')[1]")}), false)) as marks from e),
     s as (select conv_id, len(marks) as total, i, {_STRIP.format("substr(t, marks[i][2] + 1, coalesce(marks[i + 1][1], length(t)) - marks[i][2])")} as section from q, (select unnest(generate_series(1, 200)) as i) where i <= len(marks) and len(marks) >= 2),
     l as (select *, list_filter(list_transform(string_split(section, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') as lines from s where length(section) >= 150),
     n as (select *, {_STRIP.format("regexp_replace(lines[1], '^\\d{1,2}\\.\\s*', '')")} as first_, {_SPACE.format("array_to_string(lines[1:30], ' ')")} as joined from l),
     o as (select *, trim(first_, ' ,') as own, list_filter(list_transform(lines[1:8], lambda x: {_STRIP.format("regexp_replace(x, '^\\d{1,2}\\.\\s*', '')")}), lambda x: x <> '') as chunks from n),
     a as (select *, case when length(own) >= 3 and strpos(substr(joined, length(own) + 1), own) > 0 then strpos(substr(joined, length(own) + 1), own) + length(own) end as again,
           list_transform(chunks, lambda x, i: {_tidy("array_to_string(chunks[1:i], ' ')")}) as steps from o),
     c as (select *, list_filter(list_transform(steps, lambda x, i: case when regexp_matches(x, '(?:{'|'.join(ENDINGS)})$') or length(x) >= 45 and i >= 2 then x end), lambda x: x is not null)[1] as found from a)
select conv_id, cast(i as int) as bundle_index, cast(total as int) as bundle_total,
  case when again > length(own) + 1 then {_tidy("substr(joined, 1, again - 1)")} else coalesce(found, {_tidy("case when first_ = '' then 'none' else first_ end")}) end as title,
  length(section) as n, md5(section) as section_md5
from c""")
def bundle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns, numbered in one text, taken apart again into items with titles of their own."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.coalesce("text", F.lit(""))).alias("line")))).alias("ts"))
    rows = turns.select("conv_id", F.inline(B.bundle_sections(F.array_join(F.transform("ts", lambda x: x["line"]), "\n"), WORDS)))
    named = rows.select("conv_id", F.col("index").alias("bundle_index"), F.col("total").alias("bundle_total"), B.section_title(F.col("section"), F.lit("none"), ENDINGS).alias("title"), "section")
    return named.select("conv_id", "bundle_index", "bundle_total", "title", F.length("section").cast("long").alias("n"), F.md5(F.col("section").cast("binary")).alias("section_md5"))


@query()
def chosen_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn and the next one, taken as a page and its attachment under the turn's first sentence: the better text.

    Its rules are patterns made from each title, which SQL does not have; held against brute force in pytest."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("file"))
    title = F.regexp_extract("text", r"^[^.!?\n]*", 0)
    chosen = turns.join(after, ["conv_id", "turn"]).withColumn("s", B.chosen_summary(title, F.col("text"), F.col("file"), F.col("role") == "user"))
    return chosen.select("conv_id", "turn", "s.summary", "s.origin")
