"""Titles that share words, and tokens that contain each other, against all pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomwright.operators import overlap
from loomwright.plans import pipelines as P


def brute_clusters(titles, shared):
    parent = {i: i for i in titles}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(titles, 2):
        if len(titles[a] & titles[b]) >= shared:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    size = Counter(root(i) for i in titles)
    return {i: root(i) for i in titles if size[root(i)] > 1}


@pytest.mark.parametrize("shared", [1, 2, 3])
def test_clusters_equal_all_pairs(spark, shared):
    rng = random.Random(shared)
    titles = {i: {"every"} | {f"w{rng.randrange(60 if shared < 3 else 25)}" for _ in range(rng.randrange(1, 6))} for i in range(120)}
    if shared == 1:
        titles = {i: t - {"every"} | {f"own{i}"} for i, t in titles.items()}
    rows = spark.createDataFrame([(i, sorted(t)) for i, t in titles.items()], "id bigint, ws array<string>")
    got = {r["id"]: r["component"] for r in overlap.clusters(rows, "id", F.col("ws"), shared).collect()}
    assert got == brute_clusters(titles, shared)


def test_a_word_in_every_title_joins_nothing(spark):
    """No pair of 3000 titles is made for the word that all of them have."""
    rows = spark.range(3000).select("id", F.array(F.lit("all"), F.concat(F.lit("w"), (F.col("id") / 2).cast("int").cast("string"))).alias("ws"))
    found = overlap.clusters(rows, "id", F.col("ws"))
    assert found.count() == 3000 and found.where("component <> id - id % 2").count() == 0


def test_containing_tokens_equal_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc가") for _ in range(rng.randrange(2, 7)))
    left, right = {word() for _ in range(150)} | {"a" * 40, "b" * 30 + "c"}, {word() for _ in range(150)} | {"a" * 60, "c" + "b" * 30}
    as_df = lambda s: spark.createDataFrame([(t,) for t in s], "t string")
    got = overlap.containing(as_df(left), as_df(right)).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in left for b in right if a in b or b in a)


def test_needed_tokens(spark):
    rows = spark.range(1, 21).withColumn("n", F.col("id").cast("int"))
    for least, hits, trusted in ((0.22, 1, 0.6), (0.22, 2, 0.6), (0.7, 1, 1.0)):
        for r in rows.select("n", overlap.needed(F.col("n"), least, hits, trusted).alias("k")).collect():
            n = r["n"]
            assert r["k"] == min(h for h in range(1, n + 1) if h / n >= least and (h >= hits or h / n >= trusted))


def test_assignment_over_hot_tokens_and_two_words(spark, monkeypatch):
    """A token that all articles have is dealt to several tasks, with the same result; one word alone is not enough."""
    releases = spark.createDataFrame([("r1", 0, "spring music school", "2026-08-01"), ("r2", 1, "spring market", "2026-08-20"), ("r3", 2, "undated lamp", None)], "newsId string, seq int, title string, date string")
    rows = [(f"u{i}", i, f"spring music day {i}", "here", "2026-08-02") for i in range(40)] + [("one", 50, "spring", "here", "2026-08-03"), ("far", 51, "spring market", "there", "2026-08-30"), ("none", 52, "lamp, undated", "there", None)]
    articles = spark.createDataFrame(rows, "url string, seq int, title string, publisher string, publishedAt string")
    found = lambda hits: {r["url"]: r["newsId"] for r in P.assigned(releases, articles, region=("here",), least_hits=hits).collect()}
    want = {f"u{i}": "r1" for i in range(40)} | {"far": "r2", "none": "r3"}
    assert found(2) == want and found(0) == want | {"one": "r1"}
    monkeypatch.setattr(P, "HOT_TOKEN", 7)
    assert found(2) == want


def test_nearest_equals_all_pairs(spark):
    import math
    import random

    from pyspark.sql import functions as F

    dice = random.Random(3)
    value = lambda: dice.choice([round(dice.uniform(-1000, 10000), 2), round(dice.uniform(0, 3), 2), -0.0])
    odd = [math.nan, math.inf, -math.inf, None, 1e25, -1e25]
    left = [(i, dice.randint(0, 5), value()) for i in range(500)] + [(600 + i, k, v) for i, v in enumerate(odd) for k in (0, 6, 7)]
    left = [(i * 10 + n, k, v) for n, (i, k, v) in enumerate(left)]
    right = [(i, dice.randint(0, 3), value()) for i in range(200)] + [(300, 6, 5.0), (301, 6, 5.0), (302, 7, math.nan), (303, 7, math.inf), (304, 7, None), (305, 4, 77.0), (306, 7, -1e25)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, k int, v double")
    score = lambda a, b: F.round(1 - F.abs(a - b) / 11000, 6)
    met = frame(left, "url").alias("l").join(frame(right, "id").alias("r"), "k").select("url", "id", score(F.col("r.v"), F.col("l.v")).alias("score")).where("score >= 0.6")
    want = met.groupBy("url").agg(F.max(F.struct("score", (-F.col("id")).alias("first"))).alias("b")).select("url", -F.col("b.first"), "b.score")
    found = overlap.nearest(frame(left, "url"), frame(right, "id"), score).where("score >= 0.6")
    assert sorted(map(repr, found.collect())) == sorted(repr(r.__class__(url=r[0], id=r[1], score=r[2])) for r in want.collect())
    assert found.count() > 400


def test_best_match_makes_no_pairs_of_an_office(spark, tmp_path):
    """All customers of a nation used to meet all of its suppliers: 40,000,000 pairs here."""
    from pyspark.sql import functions as F

    from loomwright.plans.coverage import best_match_threshold

    for name, n, p in (("customer", 20_000, "c"), ("supplier", 2_000, "s")):
        balance = F.round(F.pmod(F.hash("id"), F.lit(1_000_000)) / 100, 2)
        spark.range(n).select(F.col("id").alias(f"{p}_{'cust' if p == 'c' else 'supp'}key"), F.lit(1).alias(f"{p}_nationkey"), balance.alias(f"{p}_acctbal")).write.parquet(f"{tmp_path}/{name}.parquet")
    found = best_match_threshold(spark, str(tmp_path))
    assert found.count() == 20_000
    made = []

    def look(plan):
        m = plan.metrics().get("numOutputRows")
        if m.isDefined():
            made.append(m.get().value())
        for i in range(plan.children().size()):
            look(plan.children().apply(i))
        if "AdaptiveSparkPlan" in plan.nodeName():
            look(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            look(plan.plan())

    found.collect()
    look(found._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 40_000


def test_assigned_equals_all_pairs_and_makes_few(spark, monkeypatch):
    import datetime
    import random

    from loomwright.plans import pipelines as P

    dice = random.Random(9)
    words = ["ab", "abc", "bcd", "xabcx", "klm", "nop", "opq", "rstu", "vwx", "yzz"]
    day = lambda: dice.choice([None, *[datetime.date(2026, 1, 1) + datetime.timedelta(dice.randint(0, 25)) for _ in range(12)]])
    title = lambda most: " ".join(dice.choice(words) for _ in range(dice.randint(0, most)))
    rel = [(i, dice.randint(0, 40), title(6), day()) for i in range(60)]
    rel = [(i, s * 100 + i, t, d) for i, s, t, d in rel]
    art = [(i, i, dice.choice(["", "here ", "there "]) + title(5), dice.choice([None, "here", "p"]), day()) for i in range(120)]
    releases = spark.createDataFrame(rel, "newsId long, seq long, title string, date date")
    articles = spark.createDataFrame(art, "url long, seq long, title string, publisher string, publishedAt date")
    want = {}
    for url, _, t, p, ad in art:
        here, at = "here" in f"{t} {p or ''}".replace("there", "-here") or "here" in t, set(t.split())
        for news, seq, rt, rd in rel:
            r = set(rt.split())
            if ad and rd and not -4 <= (ad - rd).days <= 14 or not r or not at:
                continue
            hits = sum(any(x in y or y in x for y in at) for x in r)
            score, gap = hits / len(r), abs((ad - rd).days) if ad and rd else None
            same = score >= 0.22 and (score >= 0.6 or hits >= 2 and here) if gap is not None and gap <= 4 else score >= 0.7
            if same:
                want[url] = max(want.get(url, (-1,)), (score, -(99 if gap is None else gap), -seq, news))
    got = {r["url"]: (r["newsId"], r["score"], r["gap"]) for r in P.assigned(releases, articles, region=("here",), least_hits=2).collect()}
    assert got == {u: (x[3], x[0], None if x[1] == -99 else -x[1]) for u, x in want.items()} and len(got) > 60

    made = []
    whole = P._candidates

    def counted(*args):
        found = whole(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(P, "_candidates", counted)
    same = lambda n, name, at: spark.range(n).select(F.col("id").alias(name), F.col("id").alias("seq"), F.lit("klm nop").alias("title"), F.lit("p").alias("publisher"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias(at))
    assert P.assigned(same(200, "newsId", "date"), same(200, "url", "publishedAt")).count() == 200
    assert sum(made) <= 200 * 10 * 2  # those of an article's day; all of its band were four times as many at least


def test_assigned_shuffles_no_pairs(spark, monkeypatch):
    """All releases of a week have two words in common with all of its articles: 180,000 pairs used to leave the join."""
    day = F.date_add(F.lit("2026-01-05").cast("date"), (F.col("id") % 5).cast("int"))
    titles = lambda n, own: spark.range(n).select("id", F.col("id").alias("seq"), F.concat(F.lit(f"winter reading {own}"), F.col("id")).alias("title"), day.alias("day"))
    releases = titles(300, "xx").withColumnsRenamed({"id": "newsId", "day": "date"})
    articles = titles(600, "yy").withColumnsRenamed({"id": "url", "day": "publishedAt"}).withColumn("publisher", F.lit("p"))
    whole, made = P._candidates, []

    def counted(*args):
        found = whole(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(P, "_candidates", counted)
    got = P.assigned(releases, articles).collect()
    assert sorted((r["url"], r["newsId"], r["gap"]) for r in got) == [(i, i % 5, 0) for i in range(600)] and {r["score"] for r in got} == {2 / 3}
    assert sum(made) <= 2 * 600


def test_blocks_of_odd_titles_equal_all_pairs(monkeypatch):
    """Long tokens, more tokens than a byte counts, ties, rows without a date, and articles in several pieces."""
    import pyarrow as pa

    from loomwright.operators import blocks

    dice = random.Random(11)
    word = lambda: "".join(dice.choice("abc가") for _ in range(dice.choice([2, 2, 3, 4, 5, 30])))
    many = [f"k{i}m" for i in range(300)]
    titles = lambda n, most: [sorted({word() for _ in range(dice.randint(1, most))}) for _ in range(n)]
    when = lambda: dice.choice([None, *range(20_000, 20_025)])
    rt, at = [*titles(80, 6), many, many[:280]], [*titles(150, 4), many[:290], ["x".join(many)]]
    rd, ad = [when() for _ in rt], [when() for _ in at]
    seq, here = [dice.randint(0, 9) * 100 + i for i in range(len(rt))], [dice.random() < 0.5 for _ in at]
    lists, days = pa.list_(pa.string()), lambda d: pa.array(d, pa.int32()).cast(pa.date32())
    left = pa.table({"newsId": pa.array([f"n{s}" for s in seq]), "seq": pa.array(seq), "rd": days(rd), "rt": pa.array(rt, lists)})
    right = pa.table({"g": pa.array([b"%d" % i for i in range(len(at))]), "ad": days(ad), "here": pa.array(here), "at": pa.array(at, lists)})
    want = {}
    for i, a in enumerate(at):
        for j, r in enumerate(rt):
            gap = None if ad[i] is None or rd[j] is None else abs(ad[i] - rd[j])
            if gap is not None and not -4 <= ad[i] - rd[j] <= 14:
                continue
            hits = sum(any(x in y or y in x for y in a) for x in r)
            score = hits / len(r)
            if score >= 0.7 or gap is not None and gap <= 4 and score >= 0.22 and (score >= 0.6 or hits >= 2 and here[i]):
                want[i] = max(want.get(i, (-1,)), (score, -(99 if gap is None else gap), -seq[j]))
    for width, filled in ((1024, 64), (3, 2)):
        monkeypatch.setattr(blocks, "AT_A_TIME", width)
        monkeypatch.setattr(blocks, "FILLED", filled)
        found = blocks.best_releases(left, right, 4, 14, 2).to_pylist()
        assert {int(x["g"]): (x["score"], -(99 if x["gap"] is None else x["gap"]), -x["seq"]) for x in found} == want and len(found) == len(want) > 100
        assert all(x["newsId"] == f"n{x['seq']}" for x in found)
    assert blocks.best_releases(left[:0], right, 4, 14, 2).schema == blocks.best_releases(left, right, 4, 14, 2).schema
