"""Report stages over the driver's tables: answers of agents, contracts, checks, merging, selection by ids.

The tables stand in for a newsroom's: conversations are items whose turns are points, labels are decisions of a model,
documents are sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reports as R
from ..operators.points import repeated_points
from .registry import query, table

_ITEMS = """i as (select conv_id, list(trim(text) order by turn) filter (where role = 'assistant') as points, list(trim(text) order by turn) filter (where role = 'user') as asked,
 coalesce(string_agg(text, ' ' order by turn) filter (where role = 'user'), '') as body, (conv_id % 13) / 10.0 as confidence from conversations group by 1)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, points, asked, body, confidence: the answers of a conversation and what they were given."""
    turns = table(spark, sf_dir, "conversations")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    rows = turns.groupBy("conv_id").agg(of("assistant").alias("p"), of("user").alias("a"))
    full = lambda c: F.when(F.size(c) > 0, F.transform(c, F.trim))
    return rows.select("conv_id", full(F.col("p")).alias("points"), full(F.col("a")).alias("asked"), F.array_join("a", " ").alias("body"), (F.col("conv_id") % 13 / F.lit(10.0)).alias("confidence"))


def _text(issues) -> "F.Column":  # noqa: ANN001
    """Issues as one sorted string: field:index:code."""
    return F.array_join(F.array_sort(F.transform(issues, lambda x: F.concat_ws(":", x["field"], x["pointIndex"].cast("string"), x["code"]))), ",")


def _sql_points(column: str, field: str, least: int, most: int, longest: int) -> str:
    return f"""list_concat([case when {column} is null then '{field}:-1:MISSING' end, case when len({column}) not between {least} and {most} then '{field}:-1:COUNT' end],
 coalesce(list_transform(range(len({column})), lambda k: case when length({column}[k + 1]) = 0 then '{field}:' || k || ':EMPTY' when length({column}[k + 1]) > {longest} then '{field}:' || k || ':LONG' end), []))"""


def _sql_sorted(value: str) -> str:
    return f"array_to_string(list_sort(list_filter({value}, lambda x: x is not null)), ',')"


_RANGE = "[case when confidence not between 0 and 1 then 'confidence:-1:RANGE' end]"


@query(f"""with {_ITEMS} select conv_id, {_sql_sorted(f"list_concat({_sql_points('points', 'summaryPoints', 1, 5, 320)}, list_concat({_sql_points('asked', 'sourceFacts', 1, 8, 320)}, {_RANGE}))")} as facts,
 {_sql_sorted(f"list_concat({_sql_points('points', 'summaryPoints', 1, 2, 140)}, {_RANGE})")} as own,
 {_sql_sorted(f"list_concat({_sql_points('points', 'analysisPoints', 1, 5, 320)}, list_concat({_sql_points('asked', 'applicationReviewPoints', 0, 5, 320)}, {_RANGE}))")} as analysis from i""")
def report_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the contracts of the facts, own-summary and analysis agents."""
    rows = _items(spark, sf_dir)
    shaped = rows.select("conv_id", "confidence", F.col("points").alias("summaryPoints"), F.col("asked").alias("sourceFacts"), F.col("points").alias("analysisPoints"), F.col("asked").alias("applicationReviewPoints"))
    c = F.col("confidence")
    return shaped.select("conv_id", _text(R.agent_errors(R.FACT_SECTIONS, c)).alias("facts"), _text(R.agent_errors(R.OWN_SECTIONS, c, R.OWN_POINT_LENGTH)).alias("own"), _text(R.agent_errors(R.ANALYSIS_SECTIONS, c)).alias("analysis"))


@query("""select doc_id, array_to_string(list_sort(list_filter([case when s is null or s not in ('PASS', 'REVISE') then 'status:-1:STATUS' end, case when toxic = 1 then 'issues:-1:MISSING' end,
 case when c not between 0 and 1 then 'confidence:-1:RANGE' end], lambda x: x is not null)), ',') as errors
from (select *, case doc_id % 4 when 0 then 'PASS' when 1 then 'REVISE' when 2 then 'NONE' end as s, (doc_id % 15) / 10.0 as c from labels)""")
def verification_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the contract of the verification agent."""
    rows = table(spark, sf_dir, "labels")
    k = F.col("doc_id") % 4
    status = F.when(k == 0, "PASS").when(k == 1, "REVISE").when(k == 2, "NONE")
    issues = F.when(F.col("toxic") != 1, F.array().cast(R.ISSUES))
    return rows.select("doc_id", _text(R.verification_errors(status, issues, F.col("doc_id") % 15 / F.lit(10.0))).alias("errors"))


_NUMBERS = r"list_transform(regexp_extract_all({}, '\d+(?:[.,]\d+)*'), lambda n: replace(n, ',', ''))"
_POINTS = r"""p as (select conv_id, turn, (row_number() over (partition by conv_id order by turn)) - 1 as k, trim(regexp_replace(text, '\s+', ' ', 'g')) as point from conversations where role = 'assistant'),
 q as (select p.*, body from p join i using (conv_id))"""


@query(f"""with {_ITEMS}, {_POINTS},
 x as (select conv_id, 'summaryPoints:' || k || ':LONG_COPY' as issue from q where length(point) >= 80 and contains(body, point) union all
       select conv_id, 'summaryPoints:' || k || ':UNSUPPORTED_NUMBER' from q where len(list_filter({_NUMBERS.format('point')}, lambda n: length(n) >= 2 and not list_contains({_NUMBERS.format('body')}, n))) > 0 union all
       select conv_id, 'summaryPoints:' || k || ':FORMAT' from q where length(point) = 0 or length(trim(point)) > 320 union all
       select conv_id, 'summaryPoints:-1:FORMAT' from i where points is null or len(points) > 2)
select conv_id, coalesce(string_agg(issue, ',' order by issue), '') as issues from i left join x using (conv_id) group by 1""")
def summary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of items that have only a summary of one or two points against their source."""
    rows = _items(spark, sf_dir).withColumnRenamed("points", "summaryPoints")
    return rows.select("conv_id", _text(R.item_issues(F.col("body"), R.OWN_SECTIONS)).alias("issues"))


@query()
def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation and role that nearly repeat another one, wherever it stands."""
    turns = table(spark, sf_dir, "conversations").withColumn("speaker", F.struct("conv_id", "role"))
    return repeated_points(turns, "speaker", "turn").select("speaker.conv_id", "speaker.role", "left", "right")


@query("""select o_orderkey, case when p is null then 'item:-1:OTHER' when n = 0 and st <> 'PASS' then 'item:-1:OTHER' else array_to_string(list_transform(range(n), lambda k: 'line:' || k || ':LATE'), ',') end as issues
from (select o.o_orderkey, l.o as p, coalesce(l.n, 0) as n, case when o_orderstatus = 'F' then 'PASS' else 'REVISE' end as st from orders o
 left join (select l_orderkey as o, count(*) filter (where l_returnflag = 'R') as n from lineitem where l_linenumber <= 3 and l_quantity > 10 group by 1) l on o_orderkey = o)""")
def merged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts (orders) with the verifier's rows (returned lines): missing and silent refusals become an issue of the whole."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3 and l_quantity > 10").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").cast("int").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("REVISE").alias("status")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    numbers = F.when(F.coalesce("n", F.lit(0)) > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    theirs = F.transform(numbers, lambda k: R.issue("line", k, "LATE"))
    whole = R.merged_issues(F.array().cast(R.ISSUES), F.col("status"), theirs, F.col("l_orderkey").isNotNull())
    return rows.select("o_orderkey", F.array_join(F.transform(whole, lambda x: F.concat_ws(":", x["field"], x["pointIndex"].cast("string"), x["code"])), ",").alias("issues"))


@query("""with c as (select doc_id from documents), f as (select doc_id from labels), a as (select doc_id from labels where quality = 1)
select doc_id, case when doc_id not in (select doc_id from f) then 'facts' when doc_id not in (select doc_id from a) then 'analysis' end as failed from c
where doc_id not in (select doc_id from f) or doc_id not in (select doc_id from a)""")
def failed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without facts, and those with facts but without an analysis."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    facts = labels.select("doc_id").distinct()
    none = docs.join(facts, "doc_id", "left_anti").withColumn("failed", F.lit("facts"))
    left = docs.join(facts, "doc_id", "left_semi").join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_anti").withColumn("failed", F.lit("analysis"))
    return none.unionByName(left)


@query("""select d.doc_id, d.source, l.quality, l.toxic, 'n' || n_chars as draft from documents d join labels l on d.doc_id = l.doc_id and quality = 1""")
def report_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their facts and analysis, shaped for the report; columns are pruned before they meet."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("n"), "n_chars").alias("draft"))
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    return docs.join(labels.select("doc_id", "quality"), "doc_id").join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "source", "quality", "toxic", "draft")


@query("""select d.doc_id, d.source, l.toxic from documents d join labels l using (doc_id) where quality = 0""")
def dropped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the relevance agent dropped, with the item's attributes."""
    drop = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", "toxic")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(drop, "doc_id").select("doc_id", "source", "toxic")


@query("""with pre as (select doc_id, 'rule' as via, 'DROP' as decision from documents where n_chars < 300), m as (select doc_id, 'agent' as via, case when quality = 1 then 'KEEP' else 'DROP' end as decision from labels where doc_id not in (select doc_id from pre))
select d.doc_id as seq, d.source, x.via, x.decision from documents d join (select * from pre union all select * from m) x using (doc_id)""")
def reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefiltered rows and an agent's answers by id with their source's attributes; seq keeps the order of the input."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    pre = docs.where("n_chars < 300").select("doc_id", F.lit("rule").alias("via"), F.lit("DROP").alias("decision"))
    answers = table(spark, sf_dir, "labels").select("doc_id", F.lit("agent").alias("via"), F.when(F.col("quality") == 1, "KEEP").otherwise("DROP").alias("decision"))
    every = pre.unionByName(answers.join(pre.select("doc_id"), "doc_id", "left_anti"))
    return docs.join(every, "doc_id").select(F.col("doc_id").alias("seq"), "source", "via", "decision")


@query("""with w as (select o_orderkey as id, o_orderdate as d, o_orderstatus = 'F' as sel, o_orderpriority = '1-URGENT' as own from orders),
 ids as (select id from w where sel and d >= timestamp '1995-01-01' and d < timestamp '1995-07-01' union select id from w where own and d >= timestamp '1995-01-01' and d < timestamp '1995-07-01')
select id, (select count(*) from ids where id not in (select l_orderkey from lineitem)) as missing from ids where id in (select l_orderkey from lineitem)""")
def historical_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of selected ids and of our own office's ids within the window; how many ids have no row goes with each."""
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1995-07-01"))
    ids = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).union(orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")).distinct()
    news = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    missing = ids.join(news, "id", "left_anti").agg(F.count("*").alias("missing"))
    return ids.join(news, "id", "left_semi").select("id", missing.scalar().alias("missing"))


@query("""select o_orderkey, coalesce(nullif(s_name, ''), nullif(c_name, ''), 'UNKNOWN') as department, s_acctbal as cached from orders
 left join supplier on o_custkey = s_suppkey left join customer on o_custkey = c_custkey""")
def department_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release's department by the map, else by its own field; with what is cached of it."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"), "s_name", F.col("s_acctbal").alias("cached"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(s, "o_custkey", "left").join(c, "o_custkey", "left")
    return rows.select("o_orderkey", F.coalesce(F.nullif("s_name", F.lit("")), F.nullif("c_name", F.lit("")), F.lit("UNKNOWN")).alias("department"), "cached")


@query("""select doc_id, row_number() over (order by quality desc, doc_id) as place from labels where toxic = 0 qualify place <= 200""")
def selected_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 selected items by importance, then id: a top-k, so no global sort of all rows."""
    top = table(spark, sf_dir, "labels").where("toxic = 0").orderBy(F.desc("quality"), "doc_id").limit(200)
    order = F.array_sort(F.collect_list(F.struct((-F.col("quality")).alias("k"), "doc_id")))
    return top.agg(order.alias("o")).select(F.posexplode("o").alias("p", "x")).select("x.doc_id", (F.col("p") + 1).cast("long").alias("place"))


@query("""select o_orderkey, o_orderdate from orders where o_custkey in (1, 7, 49) or o_orderpriority in ('1-URGENT') order by o_orderdate desc""")
def own_office_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of our own office, by id or by name, the latest first."""
    own = F.col("o_custkey").isin(1, 7, 49) | F.col("o_orderpriority").isin("1-URGENT")
    return table(spark, sf_dir, "orders").where(own).select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"))


@query(r"""select doc_id, substr(trim(regexp_replace(coalesce(nullif(text, ''), source, ''), '\s+', ' ', 'g')), 1, 220) as title, substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 650) as summary, coalesce(nullif(source, ''), 'unknown') as source from documents""")
def compact_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent is shown of an item: fallbacks, and at most 220 and 650 characters."""
    space = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    title = space(F.coalesce(F.nullif("text", F.lit("")), "source", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(title, 1, 220).alias("title"), F.substring(space(F.coalesce("text", F.lit(""))), 1, 650).alias("summary"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"))


@query("""select source as name, min(doc_id) as seq, arg_min(lang, doc_id) as lang from documents where source is not null group by 1""")
def public_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each name; an aggregate, so a hot name is combined before the shuffle."""
    return table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("seq"), F.min_by("lang", "doc_id").alias("lang"))


@query("""select conv_id, {'turns': list({'turn': turn, 'role': role} order by turn), 'n': count(*)}.n as n, array_to_string(list(role order by turn), ',') as roles from conversations group by 1""")
def verification_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item nested with its points for the verifier."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return nested.select("conv_id", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda x: x["role"]), ",").alias("roles"))


_SIGNALS = "contains(x, 'the') as local, contains(x, 'tion') as system, contains(x, 'and') as once, contains(x, 'promo') as personnel"


@query(f"""select doc_id, case when personnel or (not system and local and once) then 'DROP' else 'KEEP' end as decision, case when local then 'institution' else 'provincial' end as scope
from (select doc_id, {_SIGNALS} from (select doc_id, lower(coalesce(text, '')) as x from documents))""")
def rule_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by rule where no model answers."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("x"))
    has = {k: F.contains("x", F.lit(v)) for k, v in (("local", "the"), ("system", "tion"), ("once", "and"), ("personnel", "promo"))}
    decision, scope = R.rule_relevance(has["personnel"], has["system"], has["local"], has["once"])
    return x.select("doc_id", decision.alias("decision"), scope.alias("scope"))


@query("""with d as (select distinct doc_id from documents), r as (select doc_id, count(*) n from labels group by 1), k as (select doc_id from labels where quality = 1)
select 'RELEVANCE_COVERAGE' as code, (select count(*) from d where doc_id not in (select doc_id from r)) + (select count(*) from r where n > 1 or doc_id not in (select doc_id from d)) as issues union all
select 'RELEVANCE_EVIDENCE', (select count(*) from labels where doc_id % 50 = 3) union all select 'IMPORTANCE', (select count(*) from labels where quality = 1 and doc_id % 7 not between 1 and 5) union all
select 'IMPORTANCE_POLICY', (select count(*) from labels where quality = 1 and doc_id % 7 between 1 and 5 and doc_id % 7 > 2 + doc_id % 4) union all
select 'STATUS_REVISE', (select count(*) from labels where quality = 1 and toxic = 1)""")
def selection_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of issues between candidates, decisions and classifications; the selection passes if all are 0. Each check is
    an aggregate or an anti join, none needs all rows in one place."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id").distinct(), table(spark, sf_dir, "labels")
    seen = labels.groupBy("doc_id").agg(F.count("*").alias("n"))
    both = docs.withColumn("d", F.lit(True)).join(seen, "doc_id", "full").agg(F.count_if(F.col("n").isNull() | F.col("d").isNull() | (F.col("n") > 1)).alias("issues"))
    score, cap = F.col("doc_id") % 7, 2 + F.col("doc_id") % 4
    kept, fits = F.col("quality") == 1, score.between(1, 5)
    counts = labels.agg(*[F.count_if(c).alias(n) for n, c in (("RELEVANCE_EVIDENCE", F.col("doc_id") % 50 == 3), ("IMPORTANCE", kept & ~fits), ("IMPORTANCE_POLICY", kept & fits & (score > cap)), ("STATUS_REVISE", kept & (F.col("toxic") == 1)))])
    rows = counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c))])).alias("code", "issues"))
    return both.select(F.lit("RELEVANCE_COVERAGE").alias("code"), "issues").unionByName(rows)
