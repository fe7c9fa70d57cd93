"""The workloads end to end on small tables."""

from pyspark.sql import functions as F

from loomwright.plans import pipelines as P

BODY = "A summary that is long enough to be of use for a reader of the briefing. "


def test_collection(spark):
    ddl = "id string, sourceId string, source string, title string, date string, url string, summary string, collectedAt string"
    old = spark.createDataFrame([("1", "s", "Old", "A first title", "2026-08-01", "u1", BODY, "2026-08-01 09:00:00"), ("2", "s", "Old", "Much too old", "2026-01-01", "u2", BODY, "2026-01-01 09:00:00"), ("3", "s", "Old", "Kept title", "2026-08-03", "u3", BODY, "2026-08-03 09:00:00")], ddl)
    new = spark.createDataFrame([("1", "s", "Old", "A first title", "2026-08-04", "u1", BODY, "2026-08-04 07:00:00"), ("4", "s", "Old", "Kept title", "2026-08-03", "u3", BODY, "2026-08-04 07:00:00"), ("5", "s", "Old", "No body here", "2026-08-04", "u5", "short", "2026-08-04 07:00:00")], ddl)
    names = spark.createDataFrame([("s", "New name")], "id string, name string")
    got = P.collected(old, new, names, F.lit("2026-08-04 08:00:00").cast("timestamp"), 90, 10).collect()
    assert [(r["id"], r["date"], r["source"], r["fresh"]) for r in got] == [("1", "2026-08-04", "New name", True), ("4", "2026-08-03", "New name", True)]


def test_selection(spark):
    items = spark.createDataFrame([("1", "School policy changed", "the law is new"), ("2", "Staff moved", ""), ("3", "A plain event", "nothing")], "id string, title string, summary string")
    kept, counts = P.selected(items, [("staff", F.contains("title", F.lit("Staff")))], {"policy": ("policy", "law"), "event": ("event",)}, F.when(F.contains("summary", F.lit("law")), "policy_change").otherwise("routine_operation"), F.lit(5))
    assert {r["id"]: (r["category"], r["importance"], r["keywords"]) for r in kept.collect()} == {"1": ("policy", 4, ["policy", "law"]), "3": ("event", 2, ["event"])}
    assert {r["category"]: r["n"] for r in counts.collect()} == {"policy": 1, "event": 1}


def test_coverage(spark):
    releases = spark.createDataFrame([("r1", 0, "Winter reading week opens", "2026-08-01", "d1"), ("r2", 1, "Winter reading week ends", "2026-08-05", "d2"), ("r3", 2, "Other", "2026-08-05", "d2")], "newsId string, seq int, title string, date string, department string")
    articles = spark.createDataFrame([
        ("http://a/1", "Winter reading week opens today", "P", "2026-08-02"), ("http://news.google.com/1", "Winter reading week opens today!", "P on MSN", "2026-08-02"),
        ("http://a/2", "reading week ends, winter", "Q", None), ("http://a/3", "Winter reading week opens", "P", "2026-09-30"), ("http://a/4", "week", "P", "2026-08-02"),
        ("http://a/1", "A title seen later", "P", "2026-08-02"),
    ], "url string, title string, publisher string, publishedAt string")
    articles = articles.coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    m = P.assigned(releases, articles)
    assert {r["url"]: r["newsId"] for r in m.collect()} == {"http://a/1": "r1", "http://news.google.com/1": "r1", "http://a/2": "r2"}
    got = {r["newsId"]: (r["articleCount"], [x["url"] for x in r["articles"] or []]) for r in P.covered(releases, m, articles).collect()}
    assert got == {"r1": (1, ["http://a/1"]), "r2": (1, ["http://a/2"]), "r3": (0, [])}


def test_routine_clusters(spark):
    rows = [(str(i), 2, f"exam date notice {i}") for i in range(3)] + [("8", 5, "sports day photo"), ("9", 2, "sports day photo"), ("7", 2, "sports day photo"), ("6", 1, "alone")]
    items = spark.createDataFrame(rows, "newsId string, importance int, title string")
    assert {r["newsId"] for r in P.routine_clusters(items, F.split("title", " ")).collect()} == {"0", "1", "2"}
