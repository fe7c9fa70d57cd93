"""Incremental runs: a file stream is merged batch by batch into a keyed table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir


def merged_counts(spark: SparkSession, source: str, keys: list[str], at: str, files_per_batch: int = 1) -> DataFrame:
    """Count and latest `at` per key. Each batch is aggregated and written under its number, so that a batch that runs
    again overwrites itself; the parts are merged on reading."""
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    # a single file is streamed through its folder and a filter on its name
    folder, name = source.rsplit("/", 1)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    is_dir = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source) if is_dir else reader.option("pathGlobFilter", name).parquet(folder)

    def merge(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*keys).agg(F.count("*").alias("n"), F.max(at).alias(f"last_{at}"))
        part.write.mode("overwrite").parquet(f"{root}/parts/batch={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(f"{root}/parts")
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.max(f"last_{at}").alias(f"last_{at}"))
