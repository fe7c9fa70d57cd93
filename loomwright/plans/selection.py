"""Selection and report: joins over decisions, guards, contracts, checks and repair."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contracts as C
from ..operators import tables
from .registry import query, table


@query("select doc_id, lang, n_chars from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that were kept."""
    keep = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(keep, "doc_id", "left_semi")


@query("""
select d.doc_id, d.source, l.quality, l.toxic, case when n_chars >= 5000 then 'long' when n_chars >= 1000 then 'medium' else 'short' end as category
from documents d join labels l using (doc_id) where l.quality = 1 and l.toxic = 0""")
def three_way_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their relevance and classification rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kept = labels.where("quality = 1").select("doc_id", "quality")
    category = docs.select("doc_id", F.when(F.col("n_chars") >= 5000, "long").when(F.col("n_chars") >= 1000, "medium").otherwise("short").alias("category"))
    rows = docs.select("doc_id", "source").join(kept, "doc_id").join(labels.where("toxic = 0").select("doc_id", "toxic"), "doc_id").join(category, "doc_id")
    return rows.select("doc_id", "source", "quality", "toxic", "category")


@query("""
select d.doc_id, case when l.doc_id is null then 'SOURCE_MISSING' when l.toxic = 1 then 'ROUTINE_CLUSTER' when n_chars < 200 then 'BODY_QUALITY' else 'CANDIDATE' end as code
from documents d left join labels l using (doc_id)""")
def missing_source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an item is left out of the report; the first reason counts."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("there"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    rows = tables.routed(rows, ("SOURCE_MISSING", F.col("there").isNull()), ("ROUTINE_CLUSTER", F.col("toxic") == 1), ("BODY_QUALITY", F.col("n_chars") < 200))
    return rows.select("doc_id", F.coalesce("code", F.lit("CANDIDATE")).alias("code"))


@query("""
with f as (select l_orderkey as id, count(*) as n from lineitem where l_returnflag = 'R' group by 1)
select coalesce(o_orderkey, id) as id, case when n is null then 'MISSING' when o_orderkey is null then 'UNEXPECTED' else 'DUPLICATE' end as fault
from (select o_orderkey from orders where o_orderstatus = 'F') full join f on o_orderkey = id where n is null or o_orderkey is null or n > 1""")
def id_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that an answer lacks, has too much, or repeats."""
    expected = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return tables.coverage_of(expected, found, "id")


RULES = {"romance": (" que ", " del ", " les "), "german": (" und ", " der "), "english": (" the ", " and "), "secret": ("token", "copyright")}


def _rules_sql() -> str:
    has = lambda ws: " or ".join(f"contains(t, '{w}')" for w in ws)
    level = "case when contains(t, 'token') then 'system_change' when contains(t, '!!') then 'policy_change' when contains(t, '|') then 'project_change' else 'routine_operation' end"
    score = "case when contains(t, 'token') then 5 when contains(t, '!!') then 4 when contains(t, '|') then 3 else 2 end"
    category = "case " + " ".join(f"when {has(ws)} then '{c}'" for c, ws in RULES.items()) + " else 'other' end"
    return f"""
with x as (select doc_id, ' ' || lower(coalesce(text, '')) || ' ' as t, n_chars from documents),
     y as (select doc_id, {category} as category, {level} as level0, {score} as raw, n_chars > 8000 as facility, contains(t, 'warranty') as structural from x),
     z as (select *, case when facility and not structural then 'routine_operation' else level0 end as change_level from y)
select doc_id, category, change_level, cast(least(raw, case change_level when 'routine_operation' then 2 when 'project_change' then 3 when 'policy_change' then 4 else 5 end) as int) as importance from z"""


@query(_rules_sql())
def rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, level and calibrated importance by rule."""
    t = F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" "))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", t.alias("t"))
    t = F.col("t")
    level = F.when(F.contains(t, F.lit("token")), "system_change").when(F.contains(t, F.lit("!!")), "policy_change").when(F.contains(t, F.lit("|")), "project_change").otherwise("routine_operation")
    raw = F.when(F.contains(t, F.lit("token")), 5).when(F.contains(t, F.lit("!!")), 4).when(F.contains(t, F.lit("|")), 3).otherwise(2)
    category, _ = C.first_category(t, RULES, "other")
    value, own, _ = C.calibrated(raw, level, F.col("n_chars") > 8000, F.contains(t, F.lit("warranty")))
    return rows.select("doc_id", category.alias("category"), own.alias("change_level"), value.cast("int").alias("importance"))


@query("""
with x as (select doc_id, coalesce(text, '') as t, lang, case when n_chars >= 300 then 'KEEP' else 'DROP' end as d0 from documents),
     y as (select *, case when d0 = 'KEEP' then case when regexp_matches(t, '[a-z]{2,20}token') then 'support_office' when contains(t, 'token') and not contains(t, 'warranty') then 'personnel'
       when lang = 'de' and contains(t, '!!') and not contains(t, 'und') then 'institution' end end as guard_type from x)
select doc_id, case when guard_type is not null then 'DROP' else d0 end as decision, guard_type from y""")
def guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards in order over what an agent kept."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), "lang", F.when(F.col("n_chars") >= 300, "KEEP").otherwise("DROP").alias("decision"))
    has = lambda w: F.contains("t", F.lit(w))
    out = C.guarded(rows, ("support_office", F.rlike("t", F.lit("[a-z]{2,20}token"))), ("personnel", has("token") & ~has("warranty")), ("institution", (F.col("lang") == "de") & has("!!") & ~has("und")))
    return out.select("doc_id", "decision", "guard_type")


@query("""
with n as (select doc_id, count(*) as n from labels group by 1)
select doc_id, array_to_string(list_filter([case when quality not in (0, 1) or quality is null then 'QUALITY' end, case when toxic not in (0, 1) or toxic is null then 'TOXIC' end,
  case when quality = 1 and toxic = 1 then 'CONFLICT' end, case when n > 1 then 'DUPLICATE' end], lambda x: x is not null), ',') as errors
from labels join n using (doc_id)""")
def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row breaks of its contract."""
    labels = table(spark, sf_dir, "labels")
    rows = labels.join(labels.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    both = (F.col("quality") == 1) & (F.col("toxic") == 1)
    found = C.errors(("QUALITY", F.col("quality").isin(0, 1)), ("TOXIC", F.col("toxic").isin(0, 1)), ("CONFLICT", ~F.coalesce(both, F.lit(False))), ("DUPLICATE", F.col("n") == 1))
    return rows.select("doc_id", F.array_join(found, ",").alias("errors"))


_NUMBERS = r"list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '[0-9]+(?:[.,][0-9]+)*'), lambda n: replace(n, ',', '')))"


@query(f"""
with d as (select doc_id, source, {_NUMBERS.format('text')} as nums from documents), x as (select doc_id, unnest(list_filter(nums, lambda n: length(n) >= 2)) as num from d),
     f as (select num, min(doc_id) as first_doc from x group by 1)
select x.doc_id, count(*) filter (where first_doc < x.doc_id) as seen_before, count(*) as numbers from x join f using (num) group by 1""")
def number_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text its numbers of two digits or more, and how many of these an earlier text has."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(T.number_set(F.col("text")), lambda n: F.length(n) >= 2)).alias("num"))
    first = x.groupBy("num").agg(F.min("doc_id").alias("first_doc"))
    return x.join(first, "num").groupBy("doc_id").agg(F.count_if(F.col("first_doc") < F.col("doc_id")).alias("seen_before"), F.count("*").alias("numbers"))


@query(f"""
with u as (select conv_id, turn + 1 as turn, text as body from conversations where role = 'user'),
     p as (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as point, body, text from conversations join u using (conv_id, turn) where role = 'assistant')
select conv_id, turn, array_to_string(list_filter([case when length(point) < 20 then 'FORMAT' end, case when length(point) >= 80 and contains(body, point) then 'LONG_COPY' end,
  case when regexp_matches(point, '(?i)must|immediately') then 'OVERSTATEMENT' end,
  case when len(list_filter({_NUMBERS.format('point')}, lambda n: length(n) >= 2 and not list_contains({_NUMBERS.format('body')}, n))) > 0 then 'UNSUPPORTED_NUMBER' end], lambda x: x is not null), ',') as issues
from p""")
def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each answer against what it answers."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("body"))
    point = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = turns.where("role = 'assistant'").select("conv_id", "turn", point.alias("point")).join(asked, ["conv_id", "turn"])
    p, b = F.col("point"), F.col("body")
    new = F.filter(F.array_except(T.number_set(p), T.number_set(b)), lambda n: F.length(n) >= 2)
    issues = C.errors(("FORMAT", F.length(p) >= 20), ("LONG_COPY", ~((F.length(p) >= 80) & F.contains(b, p))), ("OVERSTATEMENT", ~F.rlike(p, F.lit("(?i)must|immediately"))), ("UNSUPPORTED_NUMBER", F.size(new) == 0))
    return rows.select("conv_id", "turn", F.array_join(issues, ",").alias("issues"))


@query()
def near_duplicate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that repeat the turn of the same role before them: matching-blocks ratio of 0.82 or more.

    The ratio has no counterpart among the built-in functions; it runs in an Arrow batch over pairs that meet by key."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), "role", F.col("text").alias("before"))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)

    pairs = turns.join(before, ["conv_id", "turn", "role"])
    # the ratio cannot reach the bound if one text is much the shorter
    close = 2 * F.least(F.length("text"), F.length("before")) >= 0.82 * (F.length("text") + F.length("before"))
    return pairs.where(close).withColumn("ratio", F.round(ratio("text", "before"), 6)).where("ratio >= 0.82").select("conv_id", "turn", "ratio")


@query("select doc_id, case when n_chars >= 300 then 'KEEP' else 'DROP' end as decision, cast(1 as int) as attempts, false as fallback from documents")
def batch_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule-based agent over batches of six with a contract and a fallback, as a language model would be called."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")

    def call(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": part["doc_id"], "decision": ["KEEP" if n >= 300 else "DROP" for n in part["n_chars"]]})

    def valid(part: pd.DataFrame, answer: pd.DataFrame) -> bool:
        return sorted(answer["doc_id"]) == sorted(part["doc_id"]) and bool(answer["decision"].isin(["KEEP", "DROP"]).all())

    return C.batch_agent(rows, call, valid, lambda part: pd.DataFrame({"doc_id": part["doc_id"], "decision": "KEEP"}), "doc_id bigint, decision string")


@query("select conv_id, turn, cast(case when length(text) > 800 then 3 when length(text) > 400 then 2 when length(text) > 200 then 1 else 0 end as int) as rounds, length(text) <= 1600 as ok from conversations")
def repair_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that are too long are shortened for at most three rounds; what still fails is not ok."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("size"))
    out = C.repaired(rows, lambda df: F.col("size") > 200, lambda df: df.withColumn("size", F.col("size") / 2), 3)
    return out.select("conv_id", "turn", "rounds", "ok")
