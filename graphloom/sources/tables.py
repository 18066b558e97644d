"""Scan of the Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, a file or a folder of part files, on any Hadoop file system."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
