"""Partitioning, resuming and evaluation grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans import dense_index

CONTROLS = ("correct", "shuffled", "none")


def round_robin(df: DataFrame, n: int, index: str = "idx") -> DataFrame:
    """Adds ``part`` and the place in it."""
    i = F.col(index)
    return df.withColumns({"part": (i % n).cast("int"), "place": F.floor(i / n).cast("long")})


def interleave(df: DataFrame) -> DataFrame:
    """Adds ``idx``, the inverse of ``round_robin`` for parts of any length: by place, then part."""
    return dense_index(df, "idx", ["place", "part"])


def first_rows(df: DataFrame, n: int, index: str = "idx") -> DataFrame:
    """The first ``n`` rows by index, all if it is 0 or less."""
    return df.orderBy(index).limit(n) if n > 0 else df


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't done."""
    return todo.join(done, keys, "left_anti")


def reference_file(spark, *paths: str) -> str | None:
    """The first path that exists."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def adapter_graphs(graphs: DataFrame, index: str = "idx") -> DataFrame:
    """``graph_id, adapter_control, adapter_graph``: each graph with its own adapter, the next graph's (cyclically) and
    none. With one graph there is no shuffled adapter."""
    rows = dense_index(graphs.select("graph_id", index), "_i", [index, "graph_id"])
    n = rows.count()
    nxt = rows.select(((F.col("_i") - 1 + n) % max(n, 1)).alias("_i"), F.col("graph_id").alias("_next"))
    rows = rows.join(nxt, "_i").select("graph_id", "_next")
    own = F.when(F.col("adapter_control") == "correct", F.col("graph_id")).when(F.col("adapter_control") == "shuffled", F.col("_next"))
    rows = rows.withColumn("adapter_control", F.explode(F.array(*map(F.lit, CONTROLS)))).withColumn("adapter_graph", own)
    return (rows if n > 1 else rows.filter("adapter_control <> 'shuffled'")).drop("_next")


def evaluation_grid(questions: DataFrame, controls: list[str], depths: list[int]) -> DataFrame:
    """A row for each question, control and depth; the two short lists are exploded in place."""
    control = F.explode(F.array(*map(F.lit, controls))).alias("adapter_control")
    rows = questions.select("*", control)
    return rows.withColumn("recurrence_k", F.explode(F.array(*map(F.lit, depths))))
