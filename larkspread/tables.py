"""Readers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder (a Parquet file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
