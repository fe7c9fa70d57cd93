"""JSON documents and their variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def json_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON document; none if it is missing, and none for the parts that cannot be read."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON document; what cannot be read fails the query."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The rows of a document that is a list, or an object with the list under `items`; item: their fields in DDL."""
    text = spark.read.option("wholetext", True).text(path)
    listed = F.from_json("value", f"array<struct<{_fields(item)}>>")
    nested = F.from_json("value", f"struct<items: array<struct<{_fields(item)}>>>")["items"]
    return text.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(nested)).alias("x")).select("x.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def distinct_selected(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The distinct ids that briefings of several days have selected."""
    rows = spark.read.schema("selectedItems array<struct<newsId: string>>").option("multiLine", True).json(paths)
    return rows.select(F.inline("selectedItems")).distinct()
