"""Readers of the Parquet tables a query directory holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of the directory; a file or a folder of files alike."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
