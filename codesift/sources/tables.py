"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; columns and filters are pushed to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
