"""The prediction log, or a prompt cache, as a stream of JSON lines.

A stream is appended batch by batch to a folder for each batch id. A batch that is redone after a failure has the same
id and overwrites its own folder, so no row is there twice. ``compact`` joins all batches up to the last one to one table
with the last entry of each key; ``read_entries`` takes the newest complete one of these and the batches after it, so it
may run at any time, before, during or after a compaction that breaks off.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.sources.schemas import PREDICTION

#: A prediction with its place in the log.
ENTRY = f"{PREDICTION}, pos long"
#: Key of a prediction log's row, and of a prompt cache's.
GRID = ("question_id", "recurrence_k", "adapter_control")
PROMPT = ("index", "prompt_sha256")


def read_log(spark: SparkSession, path: str, schema: str = PREDICTION, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder, as they come. With ``files_per_batch`` batches follow the files' times, so that no file may
    hold entries that come before those of an earlier one."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def latest_predictions(log: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Without rows that repeat a cell of the evaluation grid within the delay, whose state is then dropped."""
    return log.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(GRID))


def bucket_counts(log: DataFrame) -> DataFrame:
    """Running counts and accuracy by depth and control."""
    control = F.coalesce("adapter_control", F.lit("correct")).alias("adapter_control")
    return log.groupBy("recurrence_k", control).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch to the folder of its id, in place of what an earlier try left there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch-{batch_id}")

    return write


def append_stream(rows: DataFrame, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Starts appending a stream below ``path``: every so many ``seconds``, or all that is there and then ends."""
    writer = rows.writeStream.foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def _parts(spark: SparkSession, path: str) -> tuple[int, list[int], list[int]]:
    """The batch up to which the newest complete compaction goes (-1: none), the complete batches after it, and the ids of
    all compactions."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "through": []}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        m = re.fullmatch(r"(batch|through)-(\d+)", status.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[m[1]].append(int(m[2]))
    base = max(found["through"], default=-1)
    return base, sorted(b for b in found["batch"] if b > base), sorted(found["through"])


def read_entries(spark: SparkSession, path: str, keys: tuple[str, ...] = GRID, schema: str = ENTRY, pos: str = "pos") -> DataFrame:
    """The last entry of each key: of the last batch, and in it of the greatest ``pos``. A null is a key like any other."""
    base, batches, _ = _parts(spark, path)
    parts = [spark.read.schema(schema).json(f"{path}/through-{base}").withColumn("_batch", F.lit(-1))] if base >= 0 else []
    parts += [spark.read.schema(schema).json(f"{path}/batch-{b}").withColumn("_batch", F.lit(b)) for b in batches]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = [c for c in rows.columns if c != "_batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct("_batch", pos)).alias("_row"))
    return last.select("_row.*")


def compact(spark: SparkSession, path: str, keys: tuple[str, ...] = GRID, schema: str = ENTRY, pos: str = "pos") -> int:
    """Writes the entries as one table that replaces all batches so far, deletes these, and returns the last batch's id."""
    base, batches, older = _parts(spark, path)
    if not batches:
        return base
    read_entries(spark, path, keys, schema, pos).write.mode("overwrite").json(f"{path}/through-{batches[-1]}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in [*(f"batch-{b}" for b in batches), *(f"through-{b}" for b in older)]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return batches[-1]
