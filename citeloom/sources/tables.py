"""The Parquet tables of one scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``: a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
