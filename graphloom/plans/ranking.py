"""Dense numbers and running sums over a whole table without a single-task sort.

Rows are range-partitioned and treated within each partition; the partitions' totals, one row for each, give the
offsets. The partitioned table is written once, so that both uses see the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch


def _placed(df: DataFrame, order: list[Column | str] | None) -> DataFrame:
    """Adds ``_part`` and ``_at``, the partition and the place in it."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return _numbered(df)


def _numbered(df: DataFrame) -> DataFrame:
    at = F.monotonically_increasing_id()
    return Scratch(df.sparkSession, "index").save(df.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "rows")


def _with_offsets(rows: DataFrame, total: Column) -> DataFrame:
    """Adds ``_before``, the total of the partitions before a row's."""
    sizes = rows.groupBy("_part").agg(total.alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    # one row for each partition of the written table
    return rows.join(F.broadcast(offsets), "_part")


def dense_index(df: DataFrame, name: str, order: list[Column | str] | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of ``order``, or of the rows as they are scanned."""
    rows = _with_offsets(_placed(df, order), F.count("*"))
    return rows.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def dense_index_of_scan(df: DataFrame, name: str, blocks: list[str]) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of ``blocks``, and within a block in that of the scan. A block, such as a split of
    a file, is read by one task, so that no row is moved: its size and its first row give the numbers."""
    rows = Scratch(df.sparkSession, "index").save(df.withColumn("_at", F.monotonically_increasing_id()), "rows", compact=True)
    sizes = rows.groupBy(*blocks).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    offsets = sizes.select(*blocks, (F.sum("_n").over(W.orderBy(*blocks)) - F.col("_n") - F.col("_first")).alias("_shift"))
    # one row for each block of the files
    return rows.join(F.broadcast(offsets), blocks).withColumn(name, F.col("_shift") + F.col("_at")).drop(*blocks, "_at", "_shift")


def sum_before(df: DataFrame, value: str, name: str, order: list[Column | str]) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before a row."""
    rows = _with_offsets(_placed(df, order), F.sum(value))
    inside = F.sum(value).over(W.partitionBy("_part").orderBy("_at")) - F.col(value)
    return rows.withColumn(name, (F.col("_before") + inside)).drop("_part", "_at", "_before")


def dense_index_by(df: DataFrame, group: list[str], name: str, order: list[Column | str]) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each group in the ascending order of ``order``, which must tell its rows apart.

    A group of any size is spread over range partitions. The joined table has a row for each group and partition that it
    is in, so with one large group it is tiny and Spark broadcasts it.
    """
    # a sort would evaluate expressions anew for every comparison
    made = {f"_order{k}": c for k, c in enumerate(order) if isinstance(c, Column)}
    keys = [*group, *(f"_order{k}" if isinstance(c, Column) else c for k, c in enumerate(order))]
    rows = _numbered(df.withColumns(made).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*made))
    parts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part")) - F.col("_n")
    parts = parts.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), "_first", before.alias("_before"))
    match = rows["_part"] == parts["_p"]
    for k, g in enumerate(group):
        match = match & rows[g].eqNullSafe(parts[f"_g{k}"])
    number = (F.col("_before") + F.col("_at") - F.col("_first")).cast("long")
    return rows.join(parts, match).select(*df.columns, number.alias(name))


def running_sum_by(df: DataFrame, value: str, group: list[str], order: list[Column | str], upto: str, total: str) -> DataFrame:
    """Adds ``upto``, the sum of ``value`` over the rows of the group up to a row, itself included, and ``total``, that of
    the group. As in ``dense_index_by`` a group is spread over range partitions; rows of equal order are in one of them."""
    rows = _placed(df, [*group, *order])
    parts = rows.groupBy(*group, "_part").agg(F.sum(value).alias("_n"))
    in_order = W.partitionBy(*group).orderBy("_part")
    whole = F.sum("_n").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    parts = parts.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), (F.sum("_n").over(in_order) - F.col("_n")).alias("_before"), whole.alias("_whole"))
    match = rows["_part"] == parts["_p"]
    for k, g in enumerate(group):
        match = match & rows[g].eqNullSafe(parts[f"_g{k}"])
    inside = F.sum(value).over(W.partitionBy("_part", *group).orderBy("_at"))
    joined = rows.join(parts, match).withColumn("_inside", inside)
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(upto), F.col("_whole").alias(total))
