"""Deduplication, upserts and key checks over DataFrames. Ties go by an explicit sequence column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointing


def first_by(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark limits each partition's groups before it shuffles them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, seq: str) -> DataFrame:
    """The row of the greatest `at` for each key, the first of equals; an aggregate, so that a hot key is combined before
    the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(at), -F.col(seq))).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*df.columns)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows overwrite old ones by key, column by column; columns that only one side has keep that side's value."""
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full")
    cols: list[Column] = [F.col(key)]
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c == key:
            continue
        if c in old.columns and c in new.columns:
            cols.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.col(c))
    return both.select(*cols)


def coverage_of(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key and fault for ids that are missing, unexpected or repeated."""
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("_want", F.lit(True)).join(n, key, "full")
    fault = F.when(F.col("n").isNull(), "MISSING").when(F.col("_want").isNull(), "UNEXPECTED").when(F.col("n") > 1, "DUPLICATE")
    return both.select(key, fault.alias("fault")).where("fault is not null")


def routed(df: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """df with `code`: the first rule whose predicate holds, null if none does."""
    code = F.lit(None).cast("string")
    for name, predicate in reversed(rules):
        code = F.when(predicate, F.lit(name)).otherwise(code)
    return df.withColumn("code", code)


def merged_lists(kept: Column, added: Column, field: str) -> Column:
    """A list of structs and, after it, those of another list whose field the first lacks."""
    return F.concat(kept, F.filter(added, lambda x: ~F.array_contains(F.transform(kept, lambda y: y[field]), x[field])))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id) of an undirected graph. Each round takes the smallest label among the neighbours and
    then the label of that label, so that a chain of n ids takes about log n rounds; each goes through a checkpoint."""
    checkpointing(edges.sparkSession)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct().checkpoint()
    labels = both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("x")).alias("component")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        best = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        # whoever a label names may by now be known under a smaller one, and so may all whom the old label names
        told = best.groupBy(F.col("was").alias("component")).agg(F.min("component").alias("told"))
        step = best.withColumnRenamed("component", "label").join(told.withColumnRenamed("component", "was"), "was").select("id", "was", F.least("label", "told").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("component").alias("root"))
        now = step.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("root", "label")).alias("component")).checkpoint()
        labels = now.select("id", "component")
        if now.where("was <> component").isEmpty():
            return labels
