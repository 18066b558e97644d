"""Writers. Spark's commit protocol publishes a folder only once all its tasks have ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, nulls omitted."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """A small sidecar ``<path>.stats.json`` of one file."""
    stats.coalesce(1).write.mode("overwrite").json(f"{path}.stats.json")


def write_buckets(buckets: DataFrame, path: str) -> None:
    """CSV ``bucket,count,accuracy`` of each family in a folder of its own."""
    rows = buckets.select("family", "bucket", F.col("n").alias("count"), "accuracy").repartition(1, "family").sortWithinPartitions("bucket")
    rows.write.mode("overwrite").option("header", True).partitionBy("family").csv(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """Tab-separated head, relation and tail."""
    triples.select(F.concat_ws("\t", "src", "rel", "dst").alias("value")).write.mode("overwrite").text(path)
