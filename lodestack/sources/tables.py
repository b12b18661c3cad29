"""Reading the catalog's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a catalog directory (``<directory>/<name>.parquet``)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
