"""Results to files and rows of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replaced_by_date(index: DataFrame, new: DataFrame, keep: int = 0) -> DataFrame:
    """The index with the new dates' rows in place of the old, the latest first, and the `keep` newest if that is not 0."""
    rows = index.join(new.select("date").distinct(), "date", "left_anti").select(*index.columns).unionByName(new)
    return rows.orderBy(F.desc("date")).limit(keep) if keep else rows.orderBy(F.desc("date"))


def enveloped(items: DataFrame, name: str = "items") -> DataFrame:
    """One JSON document: how many rows, and the rows. For results that a reader takes whole, not for tables."""
    return items.agg(F.to_json(F.struct(F.count("*").alias("total"), F.collect_list(F.struct(*items.columns)).alias(name))).alias("value"))


def dated_copies(df: DataFrame, path: str, date: str = "window_date") -> None:
    """A partition per date, each overwritten as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def by_category(items: DataFrame) -> DataFrame:
    """category, n, lines: a bullet for each item, by importance, for a report in Markdown."""
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.col("source"), F.lit(")"))
    rows = items.select("category", F.struct((-F.col("importance")).alias("k"), "title", line.alias("line")).alias("x"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("lines"))


def caption(lines: DataFrame, limit: int, by: str = "report", seq: str = "seq") -> DataFrame:
    """The lines of each caption as long as their running length, with line ends, stays within a limit."""
    w = Window.partitionBy(by).orderBy(seq)
    n = F.sum(F.length("line")).over(w) + F.row_number().over(w) - 1
    return lines.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def last_rows(state: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The n latest rows of a state table."""
    return state.orderBy(F.desc(order)).limit(n)


def changed(new: DataFrame, old: DataFrame, key: str, content: str) -> DataFrame:
    """The new rows whose content differs from the stored one, by SHA-256."""
    digest = old.select(key, F.col("sha256").alias("_old"))
    rows = new.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).join(digest, key, "left")
    return rows.where(~F.col("sha256").eqNullSafe(F.col("_old"))).drop("_old")
