"""Constraint checks as rows ``rule, row_key``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.orchestrate import CONTROLS


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks, in one pass. A rule is a condition that must hold; null breaks it."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.explode(F.array_compact(broken)).alias("rule"), key.cast("string").alias("row_key"))


def prediction_rules() -> dict[str, Column]:
    return {
        "true_hop >= 1": F.col("true_hop").isNull() | (F.col("true_hop") >= 1),
        "recurrence_k >= 1": F.col("recurrence_k") >= 1,
        "known control": F.col("adapter_control").isin(*CONTROLS),
        "graph_id": F.length("graph_id") > 0,
        "question_id": F.length("question_id") > 0,
        "latency >= 0": F.col("latency_seconds") >= 0,
    }


def require_none(found: DataFrame) -> None:
    """Raises with the first violations, if there are any."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError("; ".join(f"{r.rule}: {r.row_key}" for r in rows))


def check_arguments(train_hops: list[int], eval_hops: list[int], depths: list[int]) -> None:
    if set(train_hops) & set(eval_hops):
        raise ValueError("train and evaluation hops overlap")
    if not depths or min(depths) < 1 or min([*train_hops, *eval_hops], default=1) < 1:
        raise ValueError("depths and hops start at 1")


def node_id_range(nodes: DataFrame) -> DataFrame:
    """Graphs whose node ids aren't 0..n-1."""
    g = nodes.groupBy("graph_id").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("low"), F.max("node_id").alias("high"))
    return g.filter((F.col("low") != 0) | (F.col("high") != F.col("n") - 1)).select(F.lit("node ids 0..n-1").alias("rule"), F.col("graph_id").cast("string").alias("row_key"))
