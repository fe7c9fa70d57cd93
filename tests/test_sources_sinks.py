"""Files, attachments and results."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import sinks
from loomwright.sources import attachments, files


def test_json_variants(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": "1", "n": 2}], "total": 1}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "1", "n": 2}, {"id": "2"}]))
    (tmp_path / "bad.json").write_text("{ no json")
    assert [tuple(r) for r in files.items(spark, f"{tmp_path}/a.json", "id string, n int").collect()] == [("1", 2)]
    assert files.items(spark, f"{tmp_path}/b.json", "id string, n int").count() == 2
    assert files.json_or_empty(spark, f"{tmp_path}/none.json", "id string").count() == 0
    assert files.json_or_empty(spark, f"{tmp_path}/bad.json", "id string").count() == 0
    assert files.json_or_empty(spark, f"{tmp_path}/b.json", "id string").count() == 2


def zipped(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, f"<d xmlns:w='w'><w:p><w:t>{text}</w:t><w:t> two</w:t></w:p><w:p/><w:p><w:t>three</w:t></w:p></d>")
    return out.getvalue()


def test_attachments(spark):
    rows = [(1, 0, "a.docx", zipped("word/document.xml", "one &amp;amp; ")), (1, 1, "b.hwpx", zipped("Contents/section0.xml", "x")), (2, 0, "c.pdf", b"%PDF-1"), (3, 0, "d.zip", b"PKbroken"), (4, 0, None, None)]
    got = attachments.attachment_texts(spark.createDataFrame(rows, "id int, pos int, path string, content binary"))
    assert {(r["id"], r["pos"]): r["text"] for r in got.collect()} == {(1, 0): "one & two\nthree", (1, 1): "x two\nthree", (2, 0): "", (3, 0): "", (4, 0): ""}
    assert {r["id"]: r["text"] for r in attachments.longest(got, "id").collect()}[1] == "one & two\nthree"


def test_attachment_parts_that_are_broken_bare_or_large():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Contents/section0.xml", "<s><p><t>first</t></p></s>")
        z.writestr("Contents/section1.xml", "<s><p><t>broken")
        z.writestr("Contents/section2.xml", "<s><t>bare</t><t>text</t></s>")
        z.writestr("Contents/section3.xml", "<s>" + " " * 50_000_001 + "<p><t>large</t></p></s>")
    assert attachments._hwpx(data.getvalue()) == ["first", "bare", "text", "large"]


def test_index_replaces_a_date(spark):
    old = spark.createDataFrame([("2026-08-01", 1), ("2026-08-02", 2)], "date string, n int")
    new = spark.createDataFrame([("2026-08-02", 9), ("2026-08-03", 3)], "date string, n int")
    assert [tuple(r) for r in sinks.replaced_by_date(old, new).collect()] == [("2026-08-03", 3), ("2026-08-02", 9), ("2026-08-01", 1)]
    assert sinks.replaced_by_date(old, new, 2).count() == 2


def test_caption_stops_at_its_limit(spark):
    df = spark.createDataFrame([(1, i, "x" * 10) for i in range(5)], "report int, seq int, line string")
    assert sinks.caption(df, 32).count() == 3


def test_report_rows_and_changes(spark):
    items = spark.createDataFrame([("a", "t1", "s", 1), ("a", "t2", "s", 5), ("b", "t3", "s", 2)], "category string, title string, source string, importance int")
    assert {r["category"]: r["lines"] for r in sinks.by_category(items).collect()} == {"a": "- t2 (s)\n- t1 (s)", "b": "- t3 (s)"}
    assert json.loads(sinks.enveloped(items).first()["value"])["total"] == 3
    old = sinks.changed(items, spark.createDataFrame([], "title string, sha256 string"), "title", "category")
    assert old.count() == 3 and sinks.changed(items, old.select("title", "sha256"), "title", "category").count() == 0


def test_body_repairs(spark):
    df = spark.createDataFrame([("◦ 모집 기간은 60\n일이며 3 월 ( 예정 ) 이다 ,",), ("본문 *footnote in English\n다음 줄",), (None,)], "t string")
    assert [r[0] for r in df.select(T.clean_body(F.col("t"))).collect()] == ["모집 기간은 60일이며 3월(예정) 이다,", "본문 다음 줄", ""]


def test_dates(spark):
    df = spark.createDataFrame([("등록일 2026. 8. 3.",), ("26-08-03 게시",), ("2026년 8월 3일",), ("none",), ("2026-13-40",)], "t string")
    assert [str(r[0]) for r in df.select(T.date_in(F.col("t"))).collect()] == ["2026-08-03", "2026-08-03", "2026-08-03", "None", "None"]
