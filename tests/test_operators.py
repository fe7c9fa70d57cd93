"""Ties, nulls and empty tables of the table operators, guards and loops."""

import pandas as pd
from pyspark.sql import functions as F

from loomwright.operators import contracts as C
from loomwright.operators import tables
from loomwright.sources import markup


def test_latest_per_key_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 4, None), ("b", 5, 1)], "k string, seq int, at int")
    got = {r["k"]: r["seq"] for r in tables.latest_per_key(df, ["k"], "at", "seq").collect()}
    assert got == {"a": 1, "b": 5}


def test_upsert_goes_by_presence_not_by_null(spark):
    old = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "id int, v string, only_old int")
    new = spark.createDataFrame([(2, None), (3, "z")], "id int, v string")
    got = {r["id"]: (r["v"], r["only_old"]) for r in tables.upserted(old, new, "id").collect()}
    assert got == {1: ("x", 10), 2: (None, 20), 3: ("z", None)}


def test_coverage_faults(spark):
    want = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    found = spark.createDataFrame([(1,), (2,), (2,), (9,)], "id int")
    assert {tuple(r) for r in tables.coverage_of(want, found, "id").collect()} == {(2, "DUPLICATE"), (3, "MISSING"), (9, "UNEXPECTED")}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (7, 7)], "a int, b int")
    got = {r["id"]: r["component"] for r in tables.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 7: 7}
    assert tables.components(edges.where("a > 99")).count() == 0


def test_first_guard_names_the_reason(spark):
    df = spark.createDataFrame([("ab", "KEEP"), ("b", "KEEP"), ("c", "KEEP"), ("a", "DROP")], "t string, decision string")
    got = C.guarded(df, ("A", F.contains("t", F.lit("a"))), ("B", F.contains("t", F.lit("b")))).collect()
    assert [(r["t"], r["decision"], r["guard_type"]) for r in got] == [("ab", "DROP", "A"), ("b", "DROP", "B"), ("c", "KEEP", None), ("a", "DROP", None)]


def test_importance_has_a_ceiling(spark):
    df = spark.createDataFrame([(5, "routine_operation", False, False), (9, "system_change", False, False), (None, "?", False, False), (5, "policy_change", True, False), (5, "policy_change", True, True)], "s int, l string, f boolean, t boolean")
    value, level, adjusted = C.calibrated(F.col("s"), F.col("l"), F.col("f"), F.col("t"))
    got = [tuple(r) for r in df.select(value, level, adjusted).collect()]
    assert got == [(2, "routine_operation", True), (5, "system_change", False), (1, "routine_operation", False), (2, "routine_operation", True), (4, "policy_change", True)]


def test_batch_agent_asks_again_then_falls_back(spark):
    def call(part):
        if 3 in set(part["id"]):
            raise ValueError("no answer")
        return pd.DataFrame({"id": part["id"], "d": "KEEP"})

    rows = spark.range(0, 6).repartition(1).selectExpr("id").sortWithinPartitions("id")
    out = C.batch_agent(rows, call, lambda p, a: len(p) == len(a), lambda p: pd.DataFrame({"id": p["id"], "d": "RULE"}), "id bigint, d string", batch=2)
    got = {r["id"]: (r["d"], r["attempts"], r["fallback"]) for r in out.collect()}
    assert got[0] == ("KEEP", 1, False) and got[2] == got[3] == ("RULE", 2, True)


def test_repair_ends_after_its_rounds(spark):
    df = spark.createDataFrame([(1, 1), (2, 5), (3, 99)], "id int, x int")
    out = C.repaired(df, lambda d: F.col("x") > 3, lambda d: d.withColumn("x", F.col("x") - 2), 2)
    assert {r["id"]: (r["rounds"], r["ok"]) for r in out.collect()} == {1: (0, True), 2: (1, True), 3: (2, False)}


def test_feed_items(spark):
    xml = """<rss><item><title><![CDATA[A - b &amp; c - Paper]]></title><link>http://x/?idxno=1</link><pubDate>Mon, 03 Aug 2026 20:00:00 GMT</pubDate></item>
    <item><title>No dash</title><link>http://x/?idxno=1</link><source url="y">Src</source></item></rss>"""
    df = spark.createDataFrame([(1, xml)], "id int, xml string")
    got = markup.feed_items(df, "id", "xml").orderBy("seq").collect()
    assert (got[0]["title"], got[0]["publisher"], str(got[0]["published"])) == ("A - b & c", "Paper", "2026-08-04")
    assert (got[1]["title"], got[1]["publisher"], got[1]["published"]) == ("No dash", "Src", None)
    assert markup.first_per_id(markup.feed_items(df, "id", "xml"), r"idxno=(\d+)", ["id"]).count() == 1


def test_components_of_a_long_chain_take_few_rounds(spark):
    edges = spark.range(0, 1000).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(5000, 5001), (5001, 5000)], "a long, b long"))
    got = {r["id"]: r["component"] for r in tables.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1001)}, 5000: 5000, 5001: 5000}
