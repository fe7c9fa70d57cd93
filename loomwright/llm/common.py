"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir

_serial = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/loomwright/{spark.sparkContext.applicationId}/{name}-{next(_serial)}"


def stored(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """Cuts the lineage: writes to the shared folder and reads it back, so that a lost executor costs no recomputation.
    A file has `most` rows at most, if that is not 0."""
    path = scratch(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files under a table from stored() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(col: str, modulus: int) -> "F.Column":
    """The rows kept from learning: crc32 of the id as text, modulo a small number, is 2."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus == 2, F.lit(False))


def slices(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about `limit` units each (one row at least), so that memory does not follow a batch's size."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def released() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other systems do without
    if trim:
        trim(0)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers give back their memory at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            released()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, limit: int = 4_000_000, by: str = "text") -> DataFrame:
    """mapInArrow whose function gets pieces of a batch with about `limit` bytes in column `by` (or struct.field)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            name, *field = by.split(".", 1)
            column = batch.column(batch.schema.get_field_index(name))
            sizes = pc.fill_null(pc.binary_length(pc.struct_field(column, field) if field else column), 0)
            for a, b in slices(np.asarray(sizes), limit):
                yield from f(batch.slice(a, b - a))

    return in_arrow(df, run, schema)
