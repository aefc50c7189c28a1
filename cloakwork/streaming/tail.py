"""A table followed as its files arrive: the analogue of a tailed source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tail(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """Rows of a folder of Parquet files, file by file in the order they came; the schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)
