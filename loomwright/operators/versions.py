"""Tables in versions: a manifest names the files of each version, and appears last, under its final name, in one rename.

Layout under a root in a folder that driver and executors share: data/<attempt>/ (Parquet), manifests/<version>.json. A reader
takes the newest manifest whose files are all there as they were written; a version that lost files counts as missing, and
the batch that made it is due again. Only manifests, which list files, pass the driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Files:
    """The few file operations of a manifest, through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def sizes(self, folder: str) -> dict[str, int]:
        if not self.fs.exists(self.path(folder)):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.path(folder))}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def written_once(self, text: str, name: str) -> bool:
        """Writes under another name and renames; False if the name is taken."""
        draft = self.path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.exists(self.path(name)) and self.fs.rename(draft, self.path(name)):
            return True
        self.fs.delete(draft, False)
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Version:
    number: int
    batch: int
    folder: str
    files: dict[str, int]


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)

    def all(self) -> list[Version]:
        """Whole versions, the newest first. A manifest that cannot be read, or whose files are gone or of another size, is
        none."""
        out = []
        for name in sorted(self.files.sizes(f"{self.root}/manifests"), reverse=True):
            if not name.endswith(".json"):
                continue
            try:
                m = json.loads(self.files.read(f"{self.root}/manifests/{name}"))
                v = Version(int(m["version"]), int(m["batch"]), m["folder"], dict(m["files"]))
            except (ValueError, KeyError, TypeError, Py4JJavaError):
                continue
            there = self.files.sizes(f"{self.root}/data/{v.folder}")
            if all(there.get(f) == n for f, n in v.files.items()):
                out.append(v)
        return out

    def read(self, schema: str, version: Version | None = None) -> DataFrame:
        """The newest whole version (or a given one); an empty table if there is none."""
        v = version or next(iter(self.all()), None)
        return self.spark.createDataFrame([], schema) if v is None else self.spark.read.schema(schema).parquet(f"{self.root}/data/{v.folder}")

    def commit(self, table: DataFrame, batch: int) -> bool:
        """Writes a table as the next version, made by a batch. Whoever is first to name a version has it: False for the
        other, whose files go."""
        names = [int(n.split(".")[0]) for n in self.files.sizes(f"{self.root}/manifests") if n.endswith(".json")]
        number, folder = max(names, default=0) + 1, uuid.uuid4().hex
        table.write.parquet(f"{self.root}/data/{folder}")
        kept = {n: s for n, s in self.files.sizes(f"{self.root}/data/{folder}").items() if n.startswith("part-")}
        done = self.files.written_once(json.dumps({"version": number, "batch": batch, "folder": folder, "files": kept}), f"{self.root}/manifests/{number:08d}.json")
        if not done:
            self.files.delete(f"{self.root}/data/{folder}")
        return done

    def pruned(self, keep: int = 2) -> None:
        """Deletes the files of all but the newest whole versions, and what no manifest names (attempts that died). Not to
        be called while another writer is at work."""
        whole = self.all()
        live = {v.folder for v in whole[:keep]}
        for folder in self.files.sizes(f"{self.root}/data"):
            if folder not in live:
                self.files.delete(f"{self.root}/data/{folder}")
        for name in self.files.sizes(f"{self.root}/manifests"):
            if name.endswith(".part") or name.split(".")[0] not in {f"{v.number:08d}" for v in whole[:keep]}:
                self.files.delete(f"{self.root}/manifests/{name}")


def merged_entries(old: DataFrame, new: DataFrame, key: str, items: str, by: Sequence[str], first: Callable[[Column], Column], filled: Sequence[str] = ()) -> DataFrame:
    """Entries with nested lists: a key's new row over its old one, its list (array of structs) the union of both, one item
    for each value of fields `by`: the least by `first` (a function of the item). filled: columns of which an old value
    stays where the new one is null or empty. Lists are merged by aggregates on key and fields, combined before the shuffle."""
    others = [c for c in new.columns if c not in (key, items)]
    tagged = old.select(*new.columns).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    value = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("_new"))) if c in filled else F.max_by(c, "_new")
    rows = tagged.groupBy(key).agg(*[value(c).alias(c) for c in others])
    each = tagged.select(key, F.explode(items).alias("item"))
    best = each.groupBy(key, *[F.col("item")[b].alias(f"_{i}") for i, b in enumerate(by)]).agg(F.min_by("item", first(F.col("item"))).alias("item"))
    lists = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(first(F.col("item")).alias("k"), F.col("item").alias("x")))).alias("l")).select(key, F.transform("l", lambda y: y["x"]).alias(items))
    empty = F.array().cast(new.schema[items].dataType)
    return rows.join(lists, key, "left").withColumn(items, F.coalesce(items, empty)).select(*new.columns)


def streamed(stream: DataFrame, root: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, keep: int = 3) -> DataFrame:
    """Merges a stream into a versioned table, batch by batch, until its source is read: merge(state, batch) -> state.

    Each version carries its batch's number. A batch that runs again (its run was stopped between the version and the
    stream's own log) is not merged twice; a version that has lost files is made anew from the one before it, for which the
    stream's log is set back."""
    spark = stream.sparkSession
    table = Versions(spark, root)

    def apply(batch: DataFrame, number: int) -> None:
        newest = next(iter(table.all()), None)
        if newest is not None and newest.batch >= number:
            return
        table.commit(merge(table.read(schema, newest), batch), number)
        table.pruned(keep)

    _set_back(table, checkpoint)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read(schema)


def _set_back(table: Versions, checkpoint: str) -> None:
    """Forgets the stream's commits of batches that no whole version holds, so that they run again over the same files."""
    newest = next(iter(table.all()), None)
    last = -1 if newest is None else newest.batch
    for name in table.files.sizes(f"{checkpoint}/commits"):
        number = name.lstrip(".").split(".")[0]
        if number.isdigit() and int(number) > last:
            table.files.delete(f"{checkpoint}/commits/{name}")


FILES, GROUPS = "group string, name string, content binary", "group string, digest string, part string"


class Groups:
    """Groups of files that are published as wholes: a group is seen with all its files of one publication, or as before.

    Contents lie in a Parquet table for each publication; a versioned table says which one holds each group, and its SHA-256
    digest over names and contents. Groups whose digest stays are not written again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.index = Versions(spark, f"{self.root}/index")

    @staticmethod
    def digests(files: DataFrame) -> DataFrame:
        """group, digest. A group's files are few (its list of names and digests is one row); contents are not moved."""
        each = files.select("group", F.struct("name", F.sha2("content", 256).alias("sha256")).alias("f"))
        return each.groupBy("group").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("f"))).cast("binary"), 256).alias("digest"))

    def published(self, files: DataFrame, number: int, repair: bool = False) -> int:
        """Publishes groups (group, name, content) under a run's number; how many changed. Other groups stay. repair: groups
        whose contents are damaged count as changed, for which all contents are read."""
        newest = next(iter(self.index.all()), None)
        if newest is not None and newest.batch >= number:
            return 0
        known = self.index.read(GROUPS, newest)
        whole = known.join(self.damaged(), "group", "left_anti") if repair else known
        new = self.digests(files).alias("n").join(whole.alias("k"), "group", "left").where(~F.col("n.digest").eqNullSafe(F.col("k.digest"))).select("group", "n.digest")
        part = f"{number:08d}-{uuid.uuid4().hex}"
        files.join(new.select("group"), "group", "left_semi").select("group", "name", "content").write.parquet(f"{self.root}/contents/{part}")
        fresh = self.digests(self.spark.read.schema(FILES).parquet(f"{self.root}/contents/{part}")).withColumn("part", F.lit(part))
        after = known.join(fresh.select("group"), "group", "left_anti").unionByName(fresh)
        return fresh.count() if self.index.commit(after, number) else 0

    def read(self, version: Version | None = None) -> DataFrame:
        """group, name, content as of the newest publication, or of an earlier one."""
        index = self.index.read(GROUPS, version)
        if next(iter(self.index.all()), None) is None:
            return self.spark.createDataFrame([], FILES)
        contents = self.spark.read.schema(FILES).option("recursiveFileLookup", "true").parquet(f"{self.root}/contents")
        contents = contents.withColumn("part", F.regexp_extract(F.input_file_name(), r"/contents/([^/]+)/", 1))
        return contents.join(index.select("group", "part"), ["group", "part"], "left_semi").select("group", "name", "content")

    def damaged(self) -> DataFrame:
        """group: those whose contents are not what was published (files that went, or changed)."""
        now = self.digests(self.read()).withColumnRenamed("digest", "now")
        return self.index.read(GROUPS).join(now, "group", "left").where(~F.col("digest").eqNullSafe(F.col("now"))).select("group")
