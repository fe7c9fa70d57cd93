"""Small parts that no query uses on its own."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.titles import period_label
from loomwright.operators import contracts as C
from loomwright.operators import sinks
from loomwright.sources import files


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(column).collect()]


def test_markup_is_escaped_once(spark):
    assert values(spark, ["a & b < c > 'd' \"e\"", "&amp;", "", None], T.html_escape(F.col("t"))) == ["a &amp; b &lt; c &gt; &#39;d&#39; &quot;e&quot;", "&amp;amp;", "", None]


def test_keywords_by_lines_and_commas(spark):
    assert values(spark, [" one, two words\n\nthree,,", "", ",", None], T.keyword_list(F.col("t"))) == [["one", "two words", "three"], [], [], None]


def test_issues_of_bodies(spark):
    texts = ["short", "a long enough body of words", "a body with a cookie notice and a Login form", "login"]
    assert values(spark, texts, T.body_issues(F.col("t"), 20, ["Cookie", "login"])) == [["SHORT"], [], ["BOILERPLATE"], ["SHORT"]]


def test_period_in_hours(spark):
    start = datetime.datetime(2024, 3, 1, 7)
    rows = spark.createDataFrame([(start, start + datetime.timedelta(hours=24)), (start, start + datetime.timedelta(minutes=90)), (start, None)], "a timestamp, b timestamp")
    assert [r[0] for r in rows.select(period_label(F.col("a"), F.col("b"))).collect()] == ["24시간", "2시간", None]


def test_batches_hold_a_bounded_number_of_rows(spark):
    rows = C.chunked(spark.range(1000), "id", 6)
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    sizes = [r["count"] for r in rows.groupBy(part, "chunk").count().collect()]
    assert max(sizes) == 6 and sum(sizes) == 1000


def test_latest_rows_of_a_state(spark):
    state = spark.createDataFrame([(i, f"2024-03-{i:02}") for i in range(1, 9)], "id int, at string")
    assert [r["id"] for r in sinks.last_rows(state, "at", 3).collect()] == [8, 7, 6]
    assert sinks.last_rows(state.where("false"), "at").count() == 0


def test_a_dates_copy_replaces_that_date_alone(spark, tmp_path):
    path = str(tmp_path / "copies")
    sinks.dated_copies(spark.createDataFrame([(1, "2024-03-01"), (2, "2024-03-02")], "id int, window_date string"), path)
    sinks.dated_copies(spark.createDataFrame([(3, "2024-03-02")], "id int, window_date string"), path)
    assert sorted((r["id"], str(r["window_date"])) for r in spark.read.parquet(path).collect()) == [(1, "2024-03-01"), (3, "2024-03-02")]


def test_unreadable_json_fails_or_is_left_out(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"id": 1}, {"id": 2}]))
    bad.write_text('[{"id": 1}, {"id": ')
    assert [r["id"] for r in files.json_strict(spark, str(good), "id int").collect()] == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_strict(spark, str(bad), "id int").collect()
    assert all(r["id"] in (None, 1) for r in files.json_or_empty(spark, str(bad), "id int").collect())


def test_distinct_ids_of_several_days(spark, tmp_path):
    paths = []
    for day, ids in enumerate((["a", "b"], ["b", "c"], [])):
        paths.append(str(tmp_path / f"{day}.json"))
        (tmp_path / f"{day}.json").write_text(json.dumps({"selectedItems": [{"newsId": i, "title": "x"} for i in ids]}))
    assert sorted(r["newsId"] for r in files.distinct_selected(spark, paths).collect()) == ["a", "b", "c"]
