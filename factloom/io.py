"""Reading the parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name; parquet keeps filters and column selection in the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
