"""Where lineage is cut: the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a temporary folder serves a session
    of one process only; on a cluster that is an error, as executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/loomwright-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def checkpointing(spark: SparkSession) -> None:
    """Lets DataFrame.checkpoint() work: names the shared folder where the context has none yet."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
