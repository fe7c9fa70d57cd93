"""WARC archives as a Spark data source, format "warc".

Writing: each task writes gzip members, one for each record, into a file of its own; a commit lists the files of the
tasks that succeeded, with places at which they can be split. A member's gzip header has its compressed length (the
extra field "sl"). Reading: partitions come from that list; equality predicates on the columns below are pushed down; a
record's headers are parsed first, and the rest of an unwanted record, or of any record with the option payload=false,
is jumped over.

Each write commits a list of its own, and a folder is read by all its lists: further writes append, and an overwrite
removes what earlier lists name.

Columns: record_id, record_type, target_uri, payload_digest (bare lower-case hex SHA-1), payload_bytes, refers_to,
payload. Defined results: null payloads are empty; null addresses leave their header out and read as null; control
characters in header values are percent-encoded; a folder without a list is read file by file; an empty table is an
archive without records. Records are told apart by page_id, address and payload: repeated page_ids keep all their
payloads, a null page_id sorts below all others and reads back as null, and of wholly equal rows with long payloads one is
the response and the rest revisit it. Payloads of any length are whole; further columns of pages are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import scratch, stored, table

SPLIT_BYTES = 16_000_000
LIST = re.compile(r"_committed.*\.json")
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"
PUSHED = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    return "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(r: dict) -> bytes:
    """One record as a gzip member that states its own length."""
    payload = r["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r["payload_bytes"]
    block = http if r["record_type"] == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <{_clean(r['record_id'])}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(r['payload_digest'])).decode()}", f"X-Payload-Length: {r['payload_bytes']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if r["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(r['target_uri'])}")
    if r["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{_clean(r['refers_to'])}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + size.to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")
    tail = zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + tail


class Committed(WriterCommitMessage):
    def __init__(self, name: str, splits: list[int]):
        self.name, self.splits = name, splits


def _lists(where: fs.FileSystem, root: str) -> list[str]:
    found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if LIST.fullmatch(x.base_name))


def _listed(where: fs.FileSystem, path: str) -> list[tuple[str, list[int]]]:
    with where.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, root = _place(self.path)
        where.create_dir(root, recursive=True)
        name, splits, at = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
        with where.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for i in range(batch.num_rows):
                    data = record_bytes(batch.slice(i, 1).to_pylist()[0])
                    if at - splits[-1] >= SPLIT_BYTES:
                        splits.append(at)
                    out.write(data)
                    at += len(data)
        return Committed(name, [*splits, at])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _place(self.path)
        where.create_dir(root, recursive=True)
        before = _lists(where, root) if self.overwrite else []
        with where.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([[m.name, m.splits] for m in messages if m is not None]).encode())  # type: ignore[attr-defined]
        for path in before:  # the list goes before its files, so that no reader finds a list of missing files
            old = _listed(where, path)
            where.delete_file(path)
            for name, _ in old:
                where.delete_file(f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _place(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(f"{root}/{m.name}")  # type: ignore[attr-defined]


class Part(InputPartition):
    def __init__(self, name: str, begin: int, end: int):
        super().__init__((name, begin, end))
        self.name, self.begin, self.end = name, begin, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  the name is the interface's
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, root = _place(self.path)
        lists = _lists(where, root)
        if lists:
            parts = [Part(name, a, b) for path in lists for name, splits in _listed(where, path) for a, b in zip(splits, splits[1:]) if b > a]
        else:
            found = where.get_file_info(fs.FileSelector(root))
            parts = [Part(x.base_name, 0, x.size) for x in sorted(found, key=lambda x: x.path) if x.base_name.endswith((".warc", ".warc.gz"))]
        return parts or [Part("", 0, 0)]  # without a partition Spark would call read() with none

    def _members(self, part: Part) -> Iterator[tuple[dict[str, str], object]]:
        """Headers of each wanted record and its block."""
        if part.end <= part.begin:
            return
        where, root = _place(self.path)
        with where.open_input_file(f"{root}/{part.name}") as f:
            at, size = part.begin, f.size()
            while at < part.end:
                head = f.read_at(min(4096, size - at), at)
                if head[:2] != b"\x1f\x8b":
                    raise ValueError(f"{part.name}: no gzip member at byte {at}")
                length = int.from_bytes(head[16:20], "little") if head[3] & 4 and head[12:14] == b"sl" else 0
                inflate = zlib.decompressobj(31)
                text, read = b"", len(head)
                chunk = head
                while b"\r\n\r\n" not in text:
                    more = inflate.decompress(chunk, 8192)
                    text += more
                    chunk = inflate.unconsumed_tail
                    if not chunk and not more:
                        if at + read >= size or inflate.eof:
                            raise ValueError(f"{part.name}: a record at byte {at} has no end of headers")
                        chunk = f.read_at(min(65536, size - at - read), at + read)
                        read += len(chunk)
                top, _, rest = text.partition(b"\r\n\r\n")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("utf-8", "replace").split("\r\n")[1:])}

                def whole(rest: bytes = rest, chunk: bytes = chunk, inflate=inflate, read: int = read, at: int = at) -> tuple[bytes, int]:
                    data = [rest]
                    while not inflate.eof:
                        if not chunk:
                            chunk = f.read_at(min(1 << 20, size - at - read), at + read)
                            if not chunk:
                                raise ValueError(f"{part.name}: a record at byte {at} is cut off")
                            read += len(chunk)
                        data.append(inflate.decompress(chunk, 1 << 20))
                        chunk = inflate.unconsumed_tail
                    return b"".join(data), read - len(inflate.unused_data)

                if length and (not self._wants(headers) or not self.payload):
                    if self._wants(headers):
                        yield headers, None
                    at += length
                    continue
                block, used = whole()
                if self._wants(headers):
                    yield headers, block[: int(headers.get("content-length", len(block)))] if self.payload else None
                at += used

    def _wants(self, headers: dict[str, str]) -> bool:
        return all(_value(headers, c) in values for c, values in self.wanted.items())

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)

        for headers, block in self._members(partition):  # type: ignore[arg-type]
            payload = None
            if block is not None and _value(headers, "record_type") == "response":
                payload = block.partition(b"\r\n\r\n")[2]  # type: ignore[attr-defined]
            length = headers.get("x-payload-length")
            rows.append((*(_value(headers, c) for c in names[:4]), int(length) if length else len(payload or b""), _value(headers, "refers_to"), payload))
            held += len(payload or b"") + 500
            if held > 4_000_000:
                yield batch()
                rows.clear()
                held = 0
        if rows:
            yield batch()


def _value(headers: dict[str, str], column: str) -> str | None:
    v = headers.get(HEADERS[column])
    if v is None:
        return None
    if column == "payload_digest":
        return base64.b32decode(v.removeprefix("sha1:")).hex() if v.startswith("sha1:") else v
    return v.strip("<>") if column in ("record_id", "refers_to") else v


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: Copies of one row that are made at once.
BLOCK = 10_000


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The rows to write: of equal payloads of `least` bytes or more, the largest page_id is the response, others revisit it."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # wholly equal rows have one key; without nulls, so that grouping and join share one shuffle of the payloads
    key = F.concat_ws(":", F.sha1(body), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("="), "url"), F.lit("null")))
    src = pages.select(key.alias("key"), "page_id", "url", body.alias("payload"))
    slim = src.where(F.octet_length("payload") >= least).select("key", "page_id", "url", F.sha1("payload").alias("digest"))
    kinds = stored(slim.groupBy("key").agg(F.min("page_id").alias("page_id"), F.min("url").alias("url"), F.min("digest").alias("digest"), F.count("*").alias("copies")), "digests")
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("has"), "url", "key")
    head = kinds.groupBy("digest").agg(F.max(rank).alias("head"), F.sum("copies").alias("k")).where("k > 1").drop("k")
    # digests of a hot group meet in a join of slim rows that can be split; the payloads themselves are dealt by key
    told = kinds.join(head.repartition(F.xxhash64("digest")), "digest").select("key", F.col("head.page_id").alias("response_id"), (F.col("head.key") == F.col("key")).alias("first"))
    # copies are counted before the shuffle; their rows come back in blocks, so that no array holds them all
    each = src.groupBy("key").agg(F.min("page_id").alias("page_id"), F.min("url").alias("url"), F.min("payload").alias("payload"), F.count("*").alias("copies"))
    rows = each.join(told, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(BLOCK).cast("long"))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + (BLOCK - 1), F.col("copies")))))
    every = rows.select("page_id", "url", "payload", "response_id", (F.col("first").isNotNull() & (~F.col("first") | (F.col("k") > 1))).alias("revisit"))
    urn = lambda c, digest: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(":"), digest)
    digest = F.sha1("payload")
    return every.select(
        urn("page_id", digest).alias("record_id"), F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        digest.alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("revisit"), urn("response_id", digest)).alias("refers_to"),
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and returns what the archives say."""
    register(spark)
    path = scratch(spark, "warc")
    records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):", 1).try_cast("long")
    whole = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"),
    )


ORACLE_SQL = """
with p as (select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
r as (select *, row_number() over w as k, first_value(page_id) over w as response_id from p window w as (partition by payload_digest order by page_id desc nulls last, url desc nulls last))
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and k > 1 then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 1000 and k > 1 then response_id end as refers_to, url from r"""
