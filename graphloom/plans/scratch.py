"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage by writing Parquet below
``spark.checkpoint.dir`` and reading it back. Unlike a block kept by the
executors such a table survives the loss of any of them, and its size on disk
lets Catalyst choose the join strategy of the next step by itself.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions without ``spark.checkpoint.dir``, by application; deleted at exit.
_local: dict[str, str] = {}


#: Delta encodings of Parquet's second version.
COMPACT = {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}


def _delete(spark: SparkSession, path: str) -> None:
    path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    path_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path_, True)


def shared_root(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``; a temporary one where it is unset in local mode."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/graphloom-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the application; results that still read them must be written before."""
    _delete(spark, shared_root(spark))


class Scratch:
    """A set of intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, compact: bool = False) -> DataFrame:
        """Write ``df``, below a folder for each value of ``partition_by``, and return the written table. ``compact`` stores
        differences of successive values, which takes far less of numbers that count up and of names in order."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").options(**(COMPACT if compact else {})).parquet(path, partitionBy=partition_by)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, f"{self.base}/{name}")
