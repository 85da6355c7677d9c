"""Named table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder that holds a Parquet file (or directory) per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
