"""Seeded samples by hash order: the same rows for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans import Scratch, dense_index, running_sum_by


def hash_key(seed: int, scope: str, *parts: Column) -> Column:
    """md5 of 'seed:scope:parts', the order of all random choices."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(scope), *[p.cast("string") for p in parts]))


def uniform(key: Column) -> Column:
    """In (0, 1], from the first 12 hex digits of a hash key."""
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def sample_rows(df: DataFrame, seed: int, scope: str, keys: list[str], limit: int) -> DataFrame:
    """``limit`` rows without replacement (all if it is 0 or less), as a distributed top-k."""
    if limit <= 0:
        return df
    return df.orderBy(hash_key(seed, scope, *map(F.col, keys)), *keys).limit(limit)


def sample_exactly(df: DataFrame, seed: int, scope: str, keys: list[str], size: int) -> DataFrame:
    """``size`` rows without replacement; an error if there are fewer. They are written, so that they are drawn once and Spark
    sees how few they are where they are joined."""
    rows = Scratch(df.sparkSession, "sample").save(sample_rows(df, seed, scope, keys, size), "rows")
    n = rows.count()
    if n < size:
        raise ValueError(f"{size} rows asked for, {n} there")
    return rows


def require_rows(df: DataFrame, group: list[str], k: int) -> None:
    """Raises if a group has fewer than ``k`` rows to draw without replacement."""
    short = df.groupBy(*group).count().filter(F.col("count") < k).limit(5).collect()
    if short:
        raise ValueError(f"fewer than {k} rows: " + ", ".join("/".join(str(r[g]) for g in group) for r in short))


def sample_per_group(df: DataFrame, group: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group. Spark prunes to the limit before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def sample_weighted(df: DataFrame, group: list[str], keys: list[str], weight: str, k: int, seed: int, scope: str, strict: bool = True) -> DataFrame:
    """``k`` rows of each group without replacement with chances by weight (Efraimidis-Spirakis). A group with fewer is an
    error, or taken whole unless ``strict``."""
    if strict:
        require_rows(df.filter(F.col(weight) > 0), group, k)
    u = uniform(hash_key(seed, scope, *map(F.col, keys)))
    return sample_per_group(df.filter(F.col(weight) > 0), group, [-F.log(u) / F.col(weight), *keys], k)


def sample_weighted_replace(df: DataFrame, group: list[str], keys: list[str], weight: str, k: int, seed: int, scope: str) -> DataFrame:
    """``k`` draws of each group with replacement: a draw takes the row whose cumulative weight it falls in.

    Adds ``draw`` from 0. The draws of a group meet its rows in an equi-join with a range condition.
    """
    rows = running_sum_by(df, weight, group, keys, "_to", "_all").withColumn("_from", F.col("_to") - F.col(weight))
    draws = df.select(*group).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draws = draws.withColumn("_u", 1 - uniform(hash_key(seed, scope, *map(F.col, group), F.col("draw"))))
    at = F.col("_u") * F.col("_all")
    return rows.join(draws, group).filter((F.col("_from") <= at) & (at < F.col("_to"))).drop("_to", "_from", "_all", "_u")


def share_split(df: DataFrame, keys: list[str], share: float, seed: int, scope: str, name: str = "split") -> DataFrame:
    """Marks the ``floor(share * n)`` rows of least hash 'train', the others 'test'."""
    rows = dense_index(df, "_place", [hash_key(seed, scope, *map(F.col, keys)), *keys])
    n = int(share * rows.count())
    return rows.withColumn(name, F.when(F.col("_place") < n, "train").otherwise("test")).drop("_place")
