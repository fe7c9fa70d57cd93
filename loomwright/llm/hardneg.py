"""Hard negatives: rows of another label whose score with an anchor comes near, but not too near, a positive's.

Scores are inner products of whole numbers, computed by the method of the four Russians: for each group of eight
dimensions an anchor has a table of its components' 256 subset sums. A candidate's components are cut into bit planes;
the eight bits of a plane in a group are one byte, which picks one sum. The sums of a plane are added, and planes are
added by shifts from the sign's plane down. Scores are exact.

Anchors meet all rows in blocks: rows are dealt into chunks and anchors into blocks by hash, of bounded expected size,
and each pair of a chunk and a block is one group of Spark's, with a bounded result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .codes import usable, whole_numbers
from .common import stored, table

#: Rows of a chunk and anchors of a block, on average; anchors whose tables are in use at a time.
CHUNK_ROWS, BLOCK_ANCHORS, AT_A_TIME = 8_192, 1_024, 32
POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in hundredths of the positive's.
LEAST, MOST = 50, 95
LOWEST = -(1 << 62)


def subset_tables(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """Groups x 256 x anchors: the sums of each subset of a group's eight components."""
    a = anchors.T.reshape(-1, 8, len(anchors))
    tables = np.zeros((len(a), 256, len(anchors)), dtype)
    for j in range(8):
        tables[:, 1 << j : 2 << j] = tables[:, : 1 << j] + a[:, j, None]
    return tables


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """Planes x groups x rows: the bytes of two's complement, the sign's plane first."""
    bits = max(int(rows.max(initial=0)), -int(rows.min(initial=0)) - 1, 0).bit_length() + 1
    planes = [np.packbits(((rows >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits - 1, -1, -1)]
    return np.ascontiguousarray(np.stack(planes)).astype(np.intp)


def _padded(rows: np.ndarray) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Rows x anchors: inner products."""
    rows, anchors = _padded(rows), _padded(anchors)
    planes = bit_planes(rows)
    largest = rows.shape[1] * int(np.abs(anchors).max(initial=0)) << len(planes)
    if largest >= 1 << 62:
        raise ValueError("a score does not fit 64 bits")
    dtype = np.int32 if largest < 1 << 30 else np.int64
    tables = subset_tables(anchors, dtype)
    total, looked_up = np.zeros((len(rows), len(anchors)), dtype), np.empty((len(rows), len(anchors)), dtype)
    for i, plane in enumerate(planes):
        total <<= 1
        for sums, byte in zip(tables, plane):
            np.take(sums, byte, axis=0, out=looked_up, mode="clip")
            (np.subtract if i == 0 else np.add)(total, looked_up, out=total)  # the sign's plane counts against
    return total


def _blocks(side: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and whole numbers of a group, by id."""
    side = side.sort_by("vec_id").combine_chunks()
    x = np.concatenate([whole_numbers(c, dims) for c in side["embedding"].chunks])
    return side["vec_id"].to_numpy(), side["label"].to_numpy(), x


def _nearest_positives(dims: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first POSITIVES rows of its label of each anchor, within a chunk."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            a_id, a_label, a = _blocks(anchors, dims)
            keys = anchors.sort_by("vec_id")["anchor"].to_numpy()
            r_id, r_label, r = _blocks(rows, dims)
            for label in np.unique(a_label):
                own, of = np.flatnonzero(a_label == label), np.flatnonzero(r_label == label)
                for i in range(0, len(own) if len(of) else 0, AT_A_TIME):
                    some = own[i : i + AT_A_TIME]
                    s = scores(r[of], a[some]).astype(np.int64)
                    s[r_id[of][:, None] == a_id[some]] = LOWEST  # the anchor itself
                    order = np.argsort(-s, axis=0, kind="stable")[:POSITIVES]
                    for j, anchor in enumerate(some):
                        out += [(keys[anchor], a_id[anchor], r_id[of[k]], s[k, j]) for k in order[:, j] if s[k, j] != LOWEST]
        cols = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "anchor_id", "positive_id", "positive_score"), cols)})

    return find


def _between(dims: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first NEGATIVES rows of another label between the bounds of each anchor and positive, within a chunk."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if anchors.num_rows and rows.num_rows:
            a_id, a_label, a = _blocks(anchors, dims)
            by_id = anchors.sort_by("vec_id")
            keys = by_id["anchor"].to_numpy()
            given = by_id["positives"].to_pylist()
            r_id, r_label, r = _blocks(rows, dims)
            for i in range(0, len(a), AT_A_TIME):
                part = slice(i, i + AT_A_TIME)
                s = scores(r, a[part]).astype(np.int64)
                s[(r_label[:, None] == a_label[part]) | (r_id[:, None] == a_id[part])] = LOWEST
                order = np.argsort(-s, axis=0, kind="stable")
                s = np.take_along_axis(s, order, axis=0)
                for n in range(max(map(len, given[part]))):
                    some = np.array([j for j, g in enumerate(given[part]) if len(g) > n])
                    positive = np.array([given[i + j][n]["positive_id"] for j in some])
                    score = np.array([given[i + j][n]["positive_score"] for j in some])
                    start = (100 * s[:, some].clip(-(1 << 56)) > MOST * score).sum(axis=0)
                    for k in range(NEGATIVES):
                        at = np.minimum(start + k, len(r) - 1)
                        found = s[at, some]
                        good = (start + k < len(r)) & (found != LOWEST)
                        good[good] &= 100 * found[good] >= LEAST * score[good]
                        j = some[good]
                        out.append(np.stack([keys[part][j], a_id[part][j], positive[good], score[good], r_id[order[at[good], j]], found[good]]))
        cols = np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), cols)})

    return find


def _met(anchors: DataFrame, rows: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, chunks: int, blocks: int) -> DataFrame:
    """f over each block of anchors with each chunk of rows."""
    dealt = lambda key, n: F.pmod(key, F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"block": dealt(F.col("anchor"), blocks)}).withColumn("chunk", each(chunks))
    right = rows.withColumns({"chunk": dealt(F.col("anchor"), chunks)}).withColumn("block", each(blocks))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(f, schema)


def _first(found: DataFrame, n: int, keys: list[str], score: str, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(name))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mined(vectors: DataFrame, anchor: Column) -> DataFrame:
    """Hard negatives of the rows for which `anchor` (a condition on vec_id, label) holds, among all rows of columns
    vec_id (bigint), embedding (floats), label; other columns are left out.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. An anchor's positives are
    the first 5 other rows of its label; for each, the first 3 rows of other labels whose score is 50 to 95 hundredths of
    the positive's. Higher scores come first, of equal ones the smaller vec_id. A positive with a score below zero has none.

    Edges: rows without vec_id, label or vector, or with an empty vector or one that holds a null, NaN or infinity, take no
    part; nor does one whose length is not that of the first usable row by vec_id. Rows equal in all three columns count
    once; different rows under one vec_id all count, but never for an anchor of that id. Components beyond 2**18 are an
    error. An empty table gives an empty one."""
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding")
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    first = kept.orderBy("vec_id", "embedding").select(F.size("embedding").alias("n")).head()
    if first is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    dims = first["n"]
    kept = kept.where(F.size("embedding") == dims).dropDuplicates(["vec_id", "label", "embedding"])
    rows = stored(kept.withColumn("anchor", F.xxhash64("vec_id", "label", "embedding")), "vectors")
    anchors = rows.where(anchor)
    counted = rows.agg(F.count("*").alias("rows"), F.count_if(anchor).alias("anchors")).head()
    chunks, blocks = max(1, -(-counted["rows"] // CHUNK_ROWS)), max(1, -(-counted["anchors"] // BLOCK_ANCHORS))

    near = _met(anchors, rows, _nearest_positives(dims), "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint", chunks, blocks)
    best = _first(near, POSITIVES, ["anchor", "anchor_id"], "positive_score", "positive_id")
    given = best.groupBy("anchor", "anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    given = given.withColumnRenamed("anchor_id", "vec_id")
    asked = stored(anchors.join(given, ["anchor", "vec_id"]), "anchors")

    schema = "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _met(asked, rows, _between(dims), schema, chunks, blocks)
    ranked = _first(found, NEGATIVES, ["anchor", "anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


ORACLE_SQL = f"""
with kept as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score
  from kept a, kept r where a.vec_id % 50 = 0 and a.vec_id <> r.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and {LEAST} * positive_score <= 100 * score and 100 * score <= {MOST} * positive_score
qualify rank <= {NEGATIVES}
"""
