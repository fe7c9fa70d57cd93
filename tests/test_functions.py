"""Column rules against independent statements of them, and the cases that the rules were made for."""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import matching as M
from loomwright.functions import text as T
from loomwright.functions import timewin as W

TEXTS = st.lists(st.text(alphabet="ab다.가나 1,2\t\n 　!|Q", max_size=40), min_size=1, max_size=20)
RELAXED = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


@RELAXED
@given(values=TEXTS)
def test_text_rules(spark, values):
    got = column(spark, values, T.normalize_space(F.col("t")), T.semantic_key(F.col("t")), T.number_set(F.col("t")), T.times(F.col("t"), "다."))
    for v, (space, key, numbers, n) in zip(values, got):
        assert space == " ".join(v.split())
        assert key == re.sub("[^0-9A-Za-z가-힣]", "", v).lower()
        assert numbers == list(dict.fromkeys(x.replace(",", "") for x in re.findall(r"[0-9]+(?:[.,][0-9]+)*", v)))
        assert n == v.count("다.")


@RELAXED
@given(values=TEXTS)
def test_similarity(spark, values):
    def tokens(text):
        return [w for w in dict.fromkeys(re.sub(r"[^0-9A-Za-z가-힣\s]", " ", text).split()) if len(w) >= 2 and not re.fullmatch("[0-9]+", w)]

    base = "ab 다가 나a aab"
    got = column(spark, values, M.similarity(M.tokens(F.lit(base)), M.tokens(F.col("t"))))
    for v, (score,) in zip(values, got):
        r, o = tokens(base), tokens(v)
        want = sum(any(x in y or y in x for y in o) for x in r) / len(r) if o else 0.0
        assert abs(score - want) < 1e-9


def test_quality_score_of_nothing_and_of_boilerplate(spark):
    long = "정책을 추진했다. " * 30
    got = column(spark, [None, "", long, long + "전체메뉴 QUICK MENU"], T.quality_score(F.col("t"), F.lit("")), T.low_quality(F.col("t"), F.lit("")))
    assert got[0] == (-1000, True) and got[1] == (-1000, True)
    assert got[2][1] is False and got[3][1] is True and got[3][0] < got[2][0]


def test_repeated_title(spark):
    got = column(spark, ["[속보] 긴 제목이 여기 있다"], T.has_repeated_title(F.lit("긴 제목이 여기 있다 그리고 본문"), F.col("t")), T.has_repeated_title(F.lit("본문"), F.col("t")))
    assert got == [(True, False)]


def test_briefing_windows(spark):
    cases = {"2026-07-13 09:00:00": ("2026-07-10 08:00:00", "2026-07-13 08:00:00"), "2026-07-17 09:00:00": ("2026-07-16 08:00:00", "2026-07-17 08:00:00"), "2026-07-14 07:30:00": ("2026-07-10 08:00:00", "2026-07-13 08:00:00")}
    start, end = W.briefing_window(F.col("t").cast("timestamp"))
    for case, (a, b) in zip(cases, column(spark, list(cases), start, end)):
        assert (str(a), str(b)) == cases[case]


def test_window_membership(spark):
    start, end = (F.lit(x).cast("timestamp") for x in ("2026-08-03 08:00:00", "2026-08-04 08:00:00"))
    values = ["2026-08-03", "2026-08-04", "2026-08-04 09:00:00", None, "no date"]
    got = column(spark, values, W.in_window(F.col("t"), start, end), W.in_window(F.col("t"), start, end, missing=False, closed=False), W.retained(F.col("t"), start))
    assert got == [(True, True, True), (True, False, True), (False, False, True), (True, False, False), (True, False, False)]


def test_same_case(spark):
    df = spark.createDataFrame([(0.1, 1, True, False), (0.3, 1, True, False), (0.3, 1, False, False), (0.65, 1, False, False), (0.65, 9, True, False), (0.7, None, False, False), (0.9, 1, False, True)], "s double, gap int, region boolean, other boolean")
    got = [r[0] for r in df.select(M.same_case(F.col("s"), F.col("gap"), F.col("region"), F.col("other"), F.lit(False))).collect()]
    assert got == [False, True, False, True, False, True, False]


def test_date_band(spark):
    d = dt.date(2026, 8, 10)
    df = spark.createDataFrame([(d - dt.timedelta(4), d), (d - dt.timedelta(5), d), (d + dt.timedelta(14), d), (d + dt.timedelta(15), d), (None, d)], "a date, r date")
    assert [r[0] for r in df.select(M.within_days(F.col("a"), F.col("r"))).collect()] == [True, False, True, False, True]


def test_fragments(spark):
    from loomwright.functions import reports as R

    df = spark.createDataFrame([("• - 첫 줄 ( 12 명 ) , 끝 -",)], "f string")
    assert df.select(R.clean_fragment(F.col("f"))).first()[0] == "첫 줄 (12명), 끝"


def test_similarity_of_long_lines(spark):
    """Each line's tokens are made once, not once for each token of the title."""
    import random

    from loomwright.functions import bodies as B

    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abcdefghijklmnopqrst") for _ in range(dice.randint(3, 9)))
    title, lines = [word() for _ in range(4000)], [[word() for _ in range(5000)] for _ in range(3)]
    lines[1] += title[:2000]
    df = spark.createDataFrame([(" ".join(title), "\n".join("# " + " ".join(x) for x in lines))], "t string, d string")
    alike = df.select(M.similarity(M.tokens(F.col("t")), M.tokens(F.split("d", "\n")[2])).alias("s"))
    assert alike._jdf.queryExecution().analyzed().toString().count("[^0-9A-Za-z") == 2
    row = alike.first()
    assert df.select(B.subtitle(F.col("d"), F.col("t"), "#").alias("x")).first()["x"] in [" ".join(x) for x in (lines[0], lines[2])]
    own, others = set(title), " ".join(lines[2])
    inner = {y for y in lines[2] if y in " ".join(own)}
    assert row["s"] == sum(x in others or any(y in x for y in inner) for x in own) / len(own)
    small = spark.createDataFrame([(["ab", "cdx", "q1"], ["xab", "cd", "zz"]), ([], ["ab"]), (["ab"], []), (None, ["ab"])], "r array<string>, a array<string>")
    assert [r[0] for r in small.select(M.similarity(F.col("r"), F.col("a"))).collect()] == [2 / 3, 0.0, 0.0, 0.0]


def test_repeated_points_equal_all_pairs(spark):
    import difflib
    import random

    from loomwright.operators.points import RATIO, repeated_points

    rng = random.Random(4)
    base = ["the school opens a new reading room for all", "teachers meet to plan the coming year together", "".join(rng.choice("abcdefgh ") for _ in range(60))]
    rows = [(g, i, "".join(c if rng.random() > 0.12 else rng.choice("xyz ") for c in rng.choice(base))) for g in range(4) for i in range(12)]
    rows += [(9, 0, ""), (9, 1, "  "), (9, 2, "one"), (9, 3, None)]
    clean = lambda t: " ".join((t or "").split())
    want = {(g, i, j) for g, i, a in rows for h, j, b in rows if g == h and i < j and difflib.SequenceMatcher(None, clean(a), clean(b)).ratio() >= RATIO}
    got = {tuple(r) for r in repeated_points(spark.createDataFrame(rows, "g int, i int, t string"), "g", "i", "t").collect()}
    assert got == want and len(want) > 10


def test_repeated_points_of_small_and_large_groups(spark):
    import difflib
    import random

    from loomwright.operators.points import FEW, RATIO, repeated_points

    dice = random.Random(2)
    base = ["".join(dice.choice("abcdefghij ") for _ in range(n)).strip() + "." for n in (20, 24, 40, 120)]

    def near(t):
        t = list(t)
        for _ in range(dice.randint(0, len(t) // 5)):
            t[dice.randrange(len(t))] = dice.choice("abcxyz")
        return "".join(t)

    rows = [(g, i, near(dice.choice(base))) for g in range(40) for i in range(2 * FEW if g == 0 else 4)]
    rows = [(g, i, " ".join(t.split())) for g, i, t in rows]
    by = {g: [r for r in rows if r[0] == g] for g in range(40)}
    want = {(g, a[1], b[1]) for g, own in by.items() for k, a in enumerate(own) for b in own[k + 1 :] if difflib.SequenceMatcher(None, a[2], b[2]).ratio() >= RATIO}
    got = [tuple(r) for r in repeated_points(spark.createDataFrame(rows, "g int, i int, t string"), "g", "i", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({g for g, _, _ in want}) > 10

    long = [(g, i, f"{g} {i} " + "".join(dice.choice("abcdefghij") for _ in range(500))) for g in range(100) for i in range(2)]
    made, found = [], repeated_points(spark.createDataFrame(long, "g int, i int, t string"), "g", "i", "t")
    found.collect()

    def look(plan):
        m = plan.metrics().get("numOutputRows")
        made.append(m.get().value() if m.isDefined() else 0)
        inner = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan.plan() if "QueryStage" in plan.nodeName() else None
        for x in [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]:
            look(x)

    look(found._jdf.queryExecution().executedPlan())
    assert 0 < max(made) < 5_000  # not a row for each of 100,000 characters
