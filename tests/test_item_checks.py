"""All issues of an item, repeated points included, against brute force."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from loomwright.functions import reports as R
from loomwright.operators.points import with_repeats

SECTIONS = ["summaryPoints", "analysisPoints", "applicationReviewPoints"]
ITEMS = [
    (1, "body", ["학생 안전 체계를 강화한다.", "학생  안전 체계를 강화했다.", "전혀 다른 내용의 문장이다."], ["학생 안전 체계를 강화한다."], []),
    (2, "body", ["a", "b"], ["같은 말", "다른 말을 한다", "같은 말", "같은 말"], ["반드시 해야 한다", "반드시 해야 한다!"]),
    (3, "body", ["only one"], ["x"], None),
    (4, "body", [" ", ""], ["x"], []),
]


def test_repeated_points_are_issues_of_their_item(spark):
    rows = spark.createDataFrame(ITEMS, "newsId int, body string, summaryPoints array<string>, analysisPoints array<string>, applicationReviewPoints array<string>")
    checked = with_repeats(rows.withColumn("issues", R.item_issues(F.col("body"))), "newsId", SECTIONS)
    got = {r["newsId"]: [(x["field"], x["pointIndex"]) for x in r["issues"] if x["code"] == "DUPLICATE"] for r in checked.collect()}
    want = {}
    for i, _, *sections in ITEMS:
        want[i] = []
        for name, points in zip(SECTIONS, sections):
            plain = [" ".join(p.split()) for p in points or []]
            want[i] += [(name, b) for a in range(len(plain)) for b in range(a + 1, len(plain)) if SequenceMatcher(None, plain[a], plain[b]).ratio() >= 0.82]
    assert got == want and len(want[2]) >= 4 and want[4]
    others = {r["newsId"]: {x["code"] for x in r["issues"]} for r in checked.collect()}
    assert "OVERSTATEMENT" in others[2] and "FORMAT" in others[4] and not others[3] - {"FORMAT"}
