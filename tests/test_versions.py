"""Versioned state, streams that are stopped and repeated, and groups of files published as wholes."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from loomwright.operators.versions import Groups, Versions, merged_entries, streamed

STATE = "newsId string, department string, articles array<struct<url:string,title:string,at:int>>"


def merge(state, batch):
    return merged_entries(state, batch, "newsId", "articles", ["title"], lambda x: F.struct(x["at"], x["url"]), filled=["department"])


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), STATE)


def plain(df):
    return {r["newsId"]: (r["department"], [tuple(a) for a in r["articles"]]) for r in df.collect()}


def test_entries_merge_lists_and_keep_what_is_missing(spark):
    old = entries(spark, ("1", "dep", [("u1", "a", 1), ("u2", "b", 5)]), ("2", None, []))
    new = entries(spark, ("1", "", [("u3", "b", 2), ("u4", "c", 9)]), ("3", "x", [("u5", "a", 1)]))
    assert plain(merge(old, new)) == {"1": ("dep", [("u1", "a", 1), ("u3", "b", 2), ("u4", "c", 9)]), "2": (None, []), "3": ("x", [("u5", "a", 1)])}


def test_versions_without_files_are_none(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    assert v.read("id bigint").count() == 0 and v.all() == []
    for n in (1, 2, 3):
        assert v.commit(spark.range(n), n)
    assert v.read("id bigint").count() == 3 and [x.number for x in v.all()] == [3, 2, 1]
    os.remove(glob.glob(f"{tmp_path}/t/data/{v.all()[0].folder}/part-*")[0])
    assert v.read("id bigint").count() == 2
    (tmp_path / "t/manifests/00000003.json").write_text("{ half")
    (tmp_path / "t/manifests/00000009.json.x.part").write_text("{}")
    assert [x.number for x in v.all()] == [2, 1]
    v.pruned(1)
    assert [x.number for x in v.all()] == [2] and len(os.listdir(tmp_path / "t/data")) == 1 and not glob.glob(f"{tmp_path}/t/manifests/*.part")


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """The one whose manifest comes second leaves nothing behind."""
    a, b = (Versions(spark, f"file://{tmp_path}/t") for _ in range(2))
    write = b.files.written_once

    def late(text, name):
        assert a.commit(spark.range(7), 1)
        return write(text, name)

    monkeypatch.setattr(b.files, "written_once", late)
    assert not b.commit(spark.range(9), 1)
    assert b.read("id bigint").count() == 7 and len(os.listdir(tmp_path / "t/data")) == 1


ROWS = [("1", "dep", [("u1", "a", 3)]), ("1", None, [("u2", "a", 1)]), ("2", None, [("u3", "b", 5)]), ("1", "new", [("u4", "c", 4)]), ("3", "", []), ("2", "d2", [("u5", "b", 6), ("u6", "e", 7)])]


def write_files(spark, folder):
    for i, row in enumerate(ROWS):
        entries(spark, row).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        part = glob.glob(f"{folder}/tmp{i}/part-*")[0]
        os.utime(part, (1_000_000_000 + i, 1_000_000_000 + i))  # files are read in this order
        shutil.copy2(part, f"{folder}/in/{i}.parquet")


def test_stream_killed_repeated_and_damaged_equals_one_pass(spark, tmp_path):
    write_files(spark, tmp_path)
    state = entries(spark).where("false")
    for row in ROWS:
        state = merge(state, entries(spark, row))
    want = plain(state)
    stream = lambda: spark.readStream.schema(STATE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda f=merge: streamed(stream(), f"file://{tmp_path}/state", STATE, f, f"file://{tmp_path}/checkpoint")
    seen = []

    def dying(old, batch):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("killed")
        return merge(old, batch)

    with pytest.raises(Exception, match="killed"):
        run(dying)
    v = Versions(spark, f"file://{tmp_path}/state")
    assert v.all()[0].batch == 1
    assert plain(run()) == want and v.all()[0].batch == 5
    number = v.all()[0].number
    assert plain(run()) == want and v.all()[0].number == number  # nothing new
    # a run that stopped after its version and before the stream's own log: the batch comes again and is not merged twice
    for f in ("5", ".5.crc"):
        os.remove(f"{tmp_path}/checkpoint/commits/{f}")
    assert plain(run()) == want and v.all()[0].number == number
    # files of the newest version vanish: it is made again from the version before
    for f in glob.glob(f"{tmp_path}/state/data/{v.all()[0].folder}/part-*"):
        os.remove(f)
    assert v.all()[0].batch == 4
    assert plain(run()) == want and v.all()[0].batch == 5


def test_groups_are_published_as_wholes(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame([(g, n, c.encode()) for g, n, c in rows], "group string, name string, content binary")
    g = Groups(spark, f"file://{tmp_path}/g")
    read = lambda v=None: sorted((r["group"], r["name"], bytes(r["content"]).decode()) for r in g.read(v).collect())
    assert read() == []
    first = [("d1", "a.json", "1"), ("d1", "a.md", "one"), ("d2", "a.json", "2")]
    assert g.published(files(*first), 1) == 2 and read() == first
    assert g.published(files(*first), 1) == 0 and g.published(files(*first), 2) == 0 and read() == first  # the same run again; the same content
    assert g.published(files(("d1", "a.json", "1"), ("d1", "a.md", "uno"), ("d3", "x", "")), 3) == 2
    after = [("d1", "a.json", "1"), ("d1", "a.md", "uno"), ("d2", "a.json", "2"), ("d3", "x", "")]
    assert read() == after and read(g.index.all()[-1]) == first
    # contents without an index entry are not seen: a writer that died half way
    files(("d1", "a.json", "half")).write.parquet(f"file://{tmp_path}/g/contents/00000004-dead")
    assert read() == after and g.damaged().count() == 0
    part = g.index.read("group string, digest string, part string").where("group = 'd2'").first()["part"]
    shutil.rmtree(tmp_path / "g/contents" / part)
    assert [r["group"] for r in g.damaged().collect()] == ["d2"]
    assert g.published(files(("d2", "a.json", "2")), 4) == 0 and g.published(files(("d2", "a.json", "2")), 5, repair=True) == 1 and read() == after
    assert g.published(files(("d2", "a.json", "2b")), 6) == 1 and read() == [*after[:2], ("d2", "a.json", "2b"), after[3]]
