"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Delimited text with a header line; quoted fields and line breaks in them are read right, blanks around fields are cut.

    Without ``schema`` all columns are strings, as the definitions do the casting.
    """
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", True).option("escape", '"')
    for k, v in options.items():
        reader = reader.option(k, v)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any format Spark knows (parquet, orc, json, text, jdbc, ...); filters and columns are pushed down where the format can."""
    return read_csv(spark, path, **options) if kind == "csv" else spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
