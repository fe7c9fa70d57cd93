"""Zip archives as rows: a Python data source that reads an archive's directory by range before any of its content.

    spark.dataSource.register(ZipSource)
    spark.read.format("zip_entries").option("paths", json.dumps([...])).load().where(F.col("name").endswith(".json"))

Rows: path, name, suffix, size, compressed, crc, content, fault. Only the archive's last bytes and its directory are read to
list it; a filter on name or suffix reaches the source, and the content of other entries is never read. Before an entry is
inflated its place, its size as stated and its archive's total are checked; while it is inflated, its size in fact. An entry
that may not be read has no content and a fault: PATH (absolute, or upwards), SIZE (the archive's entries, or this one, beyond
the limit `most`), DUPLICATE (a name, or with `unique` = suffix a suffix, that another entry has), KIND (encrypted or an
unknown method), DAMAGED (content that does not match its size or checksum). An archive without a directory is one row of
fault ARCHIVE. With `content` = false nothing is inflated."""

from __future__ import annotations

import json
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "path string, name string, suffix string, size bigint, compressed bigint, crc bigint, content binary, fault string"
#: Bytes that the entries of an archive may have together, if the reader sets no other limit.
MOST = 200_000_000
STEP = 1 << 16


def _suffix(name: str) -> str:
    last = name.rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[-1].lower() if "." in last else ""


def unsafe(name: str) -> bool:
    """Whether a name leads out of the folder that an archive is unpacked in."""
    parts = name.replace("\\", "/").split("/")
    return not name.strip("/") or name.startswith(("/", "\\")) or ".." in parts or ":" in parts[0] or "\0" in name


def faults(entries: Sequence[zipfile.ZipInfo], most: int, unique: str) -> list[str | None]:
    """What forbids each entry before anything of it is read."""
    key = (lambda e: _suffix(e.filename)) if unique == "suffix" else (lambda e: e.filename)
    many, total = Counter(map(key, entries)), sum(e.file_size for e in entries)

    def of(e: zipfile.ZipInfo) -> str | None:
        if unsafe(e.orig_filename):
            return "PATH"
        if many[key(e)] > 1:
            return "DUPLICATE"
        if e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return "KIND"
        return "SIZE" if total > most else None

    return [of(e) for e in entries]


def inflated(archive: zipfile.ZipFile, entry: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    """An entry's content in steps; never more than its stated size."""
    out = bytearray()
    try:
        with archive.open(entry) as f:
            while step := f.read(STEP):
                out += step
                if len(out) > entry.file_size:
                    return None, "DAMAGED"
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError):
        return None, "DAMAGED"
    return (bytes(out), None) if len(out) == entry.file_size else (None, "DAMAGED")


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.most = int(options.get("most", MOST))
        self.unique = options.get("unique", "name")
        self.with_content = options.get("content", "true").lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Takes tests of name and suffix; Spark applies the others."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) else None
            if column not in ("name", "suffix"):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            else:
                self.tests.append((column, "starts" if isinstance(f, StringStartsWith) else "ends", (f.value,)))

    def wanted(self, name: str | None) -> bool:
        for column, how, values in self.tests:
            if name is None:
                return False
            value = name if column == "name" else _suffix(name)
            if not (value in values if how == "in" else value.startswith(values[0]) if how == "starts" else value.endswith(values[0])):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple[Any, ...]]:
        fs, path = pafs.FileSystem.from_uri(partition.path) if "://" in partition.path else (pafs.LocalFileSystem(), partition.path.removeprefix("file:"))
        with fs.open_input_file(path) as file:
            try:
                archive = zipfile.ZipFile(pa.PythonFile(file, mode="r"))
            except (zipfile.BadZipFile, ValueError, NotImplementedError):
                if not self.tests:
                    yield partition.path, None, None, None, None, None, None, "ARCHIVE"
                return
            with archive:
                entries = [e for e in archive.infolist() if not e.is_dir()]
                for entry, fault in zip(entries, faults(entries, self.most, self.unique)):
                    if not self.wanted(entry.filename):
                        continue
                    content, broken = inflated(archive, entry) if self.with_content and fault is None else (None, None)
                    yield partition.path, entry.filename, _suffix(entry.filename), entry.file_size, entry.compress_size, entry.CRC, content, fault or broken


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> _Reader:
        return _Reader(dict(self.options))
