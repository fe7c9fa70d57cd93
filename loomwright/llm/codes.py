"""Compression of vectors: each part of a vector becomes the number of its nearest entry in that part's codebook.

Nearest entries are found by slicing and intersecting. For each dimension of a part, the entries' coordinates are sorted,
and a prefix mask says which entries (one bit each of a uint64) stand among the first so many. The squared distance to an
entry that is near in one dimension gives a first radius; in each dimension the coordinates within it are a range, whose
mask is the difference of two prefix masks. The masks' intersection holds every entry within the radius, the nearest
included, and few others; only these are measured. So results are exact."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this are refused, so that sums of squares fit 64 bits.
LARGEST = 1 << 26
#: So many rows of label sums (24 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Rows of vectors in one step of numpy.
STEP_ROWS = 16_384


def usable(vector: str) -> Column:
    """A vector that is there, not empty, and whose components are all finite numbers."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite, F.lit(False))


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of a batch's vectors, a row each. A component beyond LARGEST is an error."""
    x = np.floor(np.asarray(column.flatten(), dtype=np.float64) * SCALE)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
    return x.astype(np.int64).reshape(-1, dims)


class Codebook:
    """The entries of one part, with each dimension's sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        if not 0 < len(entries) <= 64:
            raise ValueError("a mask has 64 bits")
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable").T
        self.coordinates = [entries[o, d].copy() for d, o in enumerate(self.order)]
        self.prefixes = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(np.uint64(1) << o.astype(np.uint64))]) for o in self.order]

    def _distances(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((points - self.entries[entry]) ** 2).sum(axis=1)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """For each point, the mask of the entries within a box that surely holds the nearest."""
        reach = None
        for d, (sorted_, order) in enumerate(zip(self.coordinates, self.order)):
            at = np.minimum(np.searchsorted(sorted_, points[:, d]), len(order) - 1)
            found = self._distances(points, order[at])
            reach = found if reach is None else np.minimum(reach, found)
        radius = np.sqrt(reach.astype(np.float64)).astype(np.int64) + 1  # rounding may have taken one
        radius -= radius * radius > reach
        masks = np.full(len(points), ~np.uint64(0))
        for d, (sorted_, prefix) in enumerate(zip(self.coordinates, self.prefixes)):
            first = np.searchsorted(sorted_, points[:, d] - radius, side="left")
            last = np.searchsorted(sorted_, points[:, d] + radius, side="right")
            masks &= prefix[last] & ~prefix[first]
        return masks

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry (of equally near ones the first) and the squared distance."""
        masks = self.candidates(points)
        best, entry = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)
        open_ = np.arange(len(points))
        while len(open_):
            m = masks[open_]
            lowest = m & (~m + np.uint64(1))
            bit = np.frexp(lowest.astype(np.float64))[1].astype(np.int64) - 1
            d = self._distances(points[open_], bit)
            nearer = d < best[open_]
            best[open_[nearer]], entry[open_[nearer]] = d[nearer], bit[nearer]
            masks[open_] = m ^ lowest
            open_ = open_[m != lowest]
        return entry, best


def assigned(books: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all parts (rows x parts) and each row's squared distances, summed."""
    width = rows.shape[1] // len(books)
    found = [Codebook(b).nearest(rows[:, p * width : (p + 1) * width]) for p, b in enumerate(books)]
    return np.stack([e for e, _ in found], axis=1), sum(d for _, d in found)


def _steps(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a, b in slices(np.ones(batch.num_rows, np.int64), STEP_ROWS):
            piece = batch.slice(a, b - a)
            yield piece, whole_numbers(piece.column(piece.schema.get_field_index("embedding")), dims)


def _round(rows: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """The codebooks after one round: entries become the means of their parts, rounded down."""
    width, k = dims // PARTS, len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, width), np.int64)
        for _, x in _steps(batches, dims):
            for p, e in enumerate(assigned(books, x)[0].T):
                counts[p] += np.bincount(e, minlength=k)
                np.add.at(totals[p], e, x[:, p * width : (p + 1) * width])
        part, entry, at = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, totals.shape))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(at), pa.array(counts[part, entry]), pa.array(totals[part, entry, at])], names=["part", "entry", "at", "n", "total"])

    found = in_arrow(rows.select("embedding"), sums, "part bigint, entry bigint, at bigint, n bigint, total bigint")
    after = [b.copy() for b in books]
    # one row for each component of each entry: 64 x the vectors' length
    for r in found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        after[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return after


def learned(rows: DataFrame, dims: int) -> list[np.ndarray]:
    """Codebooks of all parts: the rows of the smallest ids, then ROUNDS rounds over all rows."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()
    start = np.floor(np.array([r["embedding"] for r in first], dtype=np.float64) * SCALE).astype(np.int64)
    books = np.split(start, PARTS, axis=1)
    for _ in range(ROUNDS):
        books = _round(rows, books, dims)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame) -> DataFrame:
    """Codes of all vectors in columns vec_id, embedding (floats), label; other columns are left out.

    Returns vec_id, code (hex, two digits a part), error (squared distances summed), label_error (error summed over the
    rows of equal label, nulls together), codebooks_sha256.

    Edges: a vector that is null, empty or holds a null, NaN or infinity is dropped, and so is one whose length is not
    that of the first usable row by vec_id; that length must be a multiple of 16, and components must stay within 2**18
    (errors). Repeated rows each count and are each returned; rows without vec_id come after all ids. Where fewer than 64
    rows are there, codebooks are shorter. An empty table gives an empty one."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label").where(usable("embedding"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).head()
    label = rows.schema["label"].dataType.simpleString()
    ids = rows.schema["vec_id"].dataType.simpleString()
    if first is None:
        return spark.createDataFrame([], f"vec_id {ids}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dims = first["n"]
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components cannot be cut into {PARTS} equal parts")
    rows = rows.where(F.size("embedding") == dims)
    books = learned(rows, dims)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _steps(batches, dims):
            entry, error = assigned(books, x)
            digits = entry.astype(np.uint8).tobytes().hex()
            texts = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = stored(in_arrow(rows.select("vec_id", "label", "embedding"), codes, f"vec_id {ids}, label {label}, code string, error bigint"), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    assign = """
{name} as (
  select v.vec_id, v.part, arg_min(b.entry, (d, b.entry)) as entry, min(d) as d
  from (select v.vec_id, v.part, v.x, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d
        from parts v join {book} b using (part)) b
  join parts v using (vec_id, part)
  group by all)"""
    update = """
{name} as (
  select b.part, b.entry, case when any_value(m.x) is null then any_value(b.x) else any_value(m.x) end as x
  from {book} b left join (
    select part, entry, list(cast(floor(total / n) as bigint) order by place) as x
    from (select p.part, a.entry, g.place, sum(p.x[g.place]) as total, count(*) as n
          from parts p join {assigned} a using (vec_id, part), (select unnest(generate_series(1, (select max(len(x)) from parts))) as place) g
          group by all) group by part, entry) m using (part, entry)
  group by b.part, b.entry)"""
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
parts as (
  select vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] as x
  from kept, (select unnest(generate_series(0, {PARTS - 1})) as part)),
book0 as (
  select part, e.entry, x from parts join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {ENTRIES}) e using (vec_id)),
{assign.format(name="a0", book="book0").strip()}, {update.format(name="book1", book="book0", assigned="a0").strip()},
{assign.format(name="a1", book="book1").strip()}, {update.format(name="book2", book="book1", assigned="a1").strip()},
{assign.format(name="a2", book="book2").strip()},
coded as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a2 group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) from book2) as codebooks_sha256
from coded join kept using (vec_id)
"""


ORACLE_SQL = _sql()
