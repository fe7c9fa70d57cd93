"""Zip archives: what is refused, what is never read, what comes through."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwright.sources import archives


def zipped(path, entries, **kw):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return str(path)


@pytest.fixture()
def load(spark):
    was = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(archives.ZipSource)

    def read(*paths, **options):
        return spark.read.format("zip_entries").options(paths=json.dumps(paths), **options).load()

    yield read
    spark.conf.set("spark.sql.python.filterPushdown.enabled", was)


def rows(df):
    return sorted((r["name"] or "", None if r["content"] is None else bytes(r["content"]), r["fault"]) for r in df.collect())


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_entries_and_what_is_refused(load, tmp_path):
    good = zipped(tmp_path / "a.zip", [("r/one.json", b"{}"), ("two.HTML", b"<html>"), ("empty.md", b"")])
    assert rows(load(good)) == [("empty.md", b"", None), ("r/one.json", b"{}", None), ("two.HTML", b"<html>", None)]
    assert {r["name"]: (r["suffix"], r["size"], r["crc"]) for r in load(f"file://{good}", content="false").collect()}["r/one.json"] == ("json", 2, 2745614147)
    up = zipped(tmp_path / "up.zip", [("../../etc/x.json", b"1"), ("a/../b.md", b"2"), ("/abs.md", b"3"), ("C:/w.md", b"4"), ("ok.md", b"5")])
    assert {r["name"]: r["fault"] for r in load(up).collect()} == {"../../etc/x.json": "PATH", "a/../b.md": "PATH", "/abs.md": "PATH", "C:/w.md": "PATH", "ok.md": None}
    twice = zipped(tmp_path / "twice.zip", [("a.json", b"1"), ("a.json", b"2"), ("b.json", b"3")])
    assert rows(load(twice)) == [("a.json", None, "DUPLICATE"), ("a.json", None, "DUPLICATE"), ("b.json", b"3", None)]
    assert {r["fault"] for r in load(twice, unique="suffix").collect()} == {"DUPLICATE"}
    (tmp_path / "no.zip").write_bytes(b"PK no archive")
    (tmp_path / "zero.zip").write_bytes(b"")
    assert rows(load(str(tmp_path / "no.zip"), str(tmp_path / "zero.zip"))) == [("", None, "ARCHIVE")] * 2


def test_bombs_are_not_inflated(load, tmp_path, monkeypatch):
    bomb = zipped(tmp_path / "bomb.zip", [("big.json", b"0" * 5_000_000), ("small.md", b"x")])
    assert rows(load(bomb, most="1000000")) == [("big.json", None, "SIZE"), ("small.md", None, "SIZE")]
    # a directory that states less than there is: the first step beyond it ends the reading
    raw = bytearray(open(bomb, "rb").read())
    for at in (raw.find(b"PK\x01\x02") + 24, 22):
        raw[at : at + 4] = (10).to_bytes(4, "little")
    (tmp_path / "liar.zip").write_bytes(raw)
    assert rows(load(str(tmp_path / "liar.zip"), most="1000000"))[0] == ("big.json", None, "DAMAGED")


def test_damaged_content_is_told(load, tmp_path):
    path = zipped(tmp_path / "a.zip", [("a.json", bytes(range(256)) * 20), ("b.json", b"whole")])
    raw = bytearray(open(path, "rb").read())
    raw[60] ^= 255
    (tmp_path / "bad.zip").write_bytes(raw)
    assert rows(load(str(tmp_path / "bad.zip"))) == [("a.json", None, "DAMAGED"), ("b.json", b"whole", None)]


def test_filters_reach_the_source_and_other_content_is_not_read(load, tmp_path):
    """An entry of 8 MB that is filtered out: only the directory and the other entry are read."""
    import random

    path = zipped(tmp_path / "a.zip", [("big.bin", random.Random(1).randbytes(8_000_000)), ("a.json", b"1"), ("b.json", b"2")])
    assert rows(load(path).where("name = 'a.json'")) == [("a.json", b"1", None)]
    assert len(rows(load(path).where("suffix in ('json', 'md') and size > 0"))) == 2
    reader = archives._Reader({"paths": json.dumps([path])})
    from pyspark.sql.datasource import GreaterThan, StringEndsWith

    left = list(reader.pushFilters([StringEndsWith(("name",), ".json"), GreaterThan(("size",), 0)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    read = []

    class Counting(io.FileIO):
        def read(self, n=-1):
            data = super().read(n)
            read.append(len(data))
            return data

    class Local:
        def open_input_file(self, p):
            return Counting(p)

    original = archives.pafs.LocalFileSystem, archives.pa.PythonFile
    archives.pafs.LocalFileSystem, archives.pa.PythonFile = Local, lambda f, mode: f
    try:
        found = list(reader.read(archives._Archive(path)))
    finally:
        archives.pafs.LocalFileSystem, archives.pa.PythonFile = original
    assert [r[1] for r in found] == ["a.json", "b.json"] and sum(read) < 100_000


def test_listing_feeds_a_plan(load, tmp_path):
    paths = [zipped(tmp_path / f"{i}.zip", [("report.json", json.dumps({"n": i})), ("report.html", "<html>")]) for i in range(5)]
    got = load(*paths).where("suffix = 'json'").select(F.get_json_object(F.col("content").cast("string"), "$.n").cast("int").alias("n"))
    assert sorted(r["n"] for r in got.collect()) == list(range(5))
