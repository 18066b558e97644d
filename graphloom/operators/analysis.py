"""Accuracy by bucket, per-question depth, rank correlation and reports.

A prediction log has ``question_id, true_hop, recurrence_k, adapter_control, split, correct, pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans import sum_before


def with_defaults(log: DataFrame) -> DataFrame:
    """The control is 'correct' and the split 'unknown' where absent."""
    return log.withColumns({"adapter_control": F.coalesce("adapter_control", F.lit("correct")), "split": F.coalesce("split", F.lit("unknown"))})


def accuracy_buckets(log: DataFrame) -> DataFrame:
    """``family, bucket, n, accuracy`` by hop, depth and control (known hops), by depth and control, and by split,
    depth and control. One aggregate to the finest buckets, the families from its sums."""
    hop = F.when(F.col("true_hop") >= 1, F.col("true_hop"))
    fine = with_defaults(log).groupBy(hop.alias("hop"), F.col("recurrence_k").alias("k"), F.col("adapter_control").alias("control"), "split").agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("good")
    )
    known = F.col("hop").isNotNull()
    tail = F.concat(F.lit("k="), F.col("k").cast("string"), F.lit("|adapter="), "control")
    families = F.array(
        F.when(known, F.struct(F.lit("hop").alias("family"), F.concat(F.lit("hop="), F.col("hop").cast("string"), F.lit("|"), tail).alias("bucket"))),
        F.struct(F.lit("k").alias("family"), tail.alias("bucket")),
        F.struct(F.lit("split").alias("family"), F.concat(F.lit("split="), "split", F.lit("|"), tail).alias("bucket")),
    )
    rows = fine.select(F.explode(F.array_compact(families)).alias("f"), "n", "good")
    return rows.groupBy("f.family", "f.bucket").agg(F.sum("n").alias("n"), (F.sum("good") / F.sum("n")).alias("accuracy"))


def overall_summary(log: DataFrame) -> DataFrame:
    """One row of counts and accuracies over rows, 0 where there are none."""
    good = F.col("correct").cast("double")
    own = F.col("adapter_control") == "correct"
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return with_defaults(log).agg(
        F.count("*").alias("n"),
        zero(F.avg(good)).alias("accuracy"),
        zero(F.avg(F.when(own, good))).alias("correct_adapter_accuracy"),
        F.count(F.when(F.col("true_hop") >= 1, 1)).alias("known_hop"),
        F.count(F.when(F.coalesce(F.col("true_hop") < 1, F.lit(True)), 1)).alias("unknown_hop"),
    )


def best_depths(log: DataFrame) -> DataFrame:
    """``question_id, true_hop, best_k`` over rows of the correct adapter: the least depth that succeeds, null if none
    does. The hop is that of the last row with one."""
    own = with_defaults(log).filter(F.col("adapter_control") == "correct")
    hop = F.max_by("true_hop", F.when(F.col("true_hop").isNotNull(), F.col("pos")))
    return own.groupBy("question_id").agg(hop.alias("true_hop"), F.min(F.when(F.col("correct"), F.col("recurrence_k"))).alias("best_k"))


def solved_counts(best: DataFrame) -> DataFrame:
    return best.agg(F.count("best_k").alias("solved"), F.count(F.when(F.col("best_k").isNull(), 1)).alias("unsolved"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds fractional ranks, from the counts of distinct values."""
    counts = sum_before(df.groupBy(value).agg(F.count("*").alias("_ties")), "_ties", "_less", [value])
    ranks = counts.select(value, (F.col("_less") + (F.col("_ties") + 1) / 2.0).alias(name))
    return df.join(ranks, value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, rho``: rank correlation, 0 for fewer than two rows or no variance."""
    ranked = average_ranks(average_ranks(df, x, "_rx"), y, "_ry")
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.sqrt(F.var_pop("_rx") * F.var_pop("_ry")))
    return ranked.agg(F.count("*").alias("n"), F.coalesce(F.when(F.count("*") > 1, rho), F.lit(0.0)).alias("rho"))


def depth_correlation(log: DataFrame) -> DataFrame:
    """Rank correlation of hop and best depth over solved questions of known hop."""
    return spearman(best_depths(log).filter("best_k is not null and true_hop >= 1"), "true_hop", "best_k")


def wrong_answers(rows: DataFrame, score: Column, graphs: DataFrame | None = None) -> DataFrame:
    """``id, wrong`` (array of question, target, response in row order) of rows with score 0, with ``graph`` if given."""
    item = F.struct("pos", "question", "target", "response")
    found = rows.filter(score == 0).groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = found.select("id", F.transform("items", lambda i: F.struct(i["question"], i["target"], i["response"])).alias("wrong"))
    return out if graphs is None else out.join(graphs.select("id", "graph"), "id")


def split_sizes(available: DataFrame, selected: DataFrame) -> DataFrame:
    """``split, available, selected``."""
    a = available.groupBy("split").agg(F.count("*").alias("available"))
    return a.join(selected.groupBy("split").agg(F.count("*").alias("selected")), "split", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


def graph_sizes(triples: DataFrame) -> DataFrame:
    """One row: nodes, edges and relations."""
    nodes = triples.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.count_distinct("n").alias("n_nodes"))
    rest = triples.agg(F.count("*").alias("n_edges"), F.count_distinct("rel").alias("n_relations"))
    return nodes.crossJoin(rest)
