"""Text and retrieval metrics. A row has a ``prediction`` and ``targets`` (array); a row's score is its best target's, or
another aggregate of ``AGGREGATES`` over its targets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import answer_tokens, normalize_answer

RETRIEVAL_THRESHOLD = 0.8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; an expression within a lambda is evaluated for every element."""
    return F.transform(F.array(value), body)[0]


#: Aggregates of the scores of a row's targets.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "max": F.array_max,
    "min": F.array_min,
    "mean": lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)),
}


def target_scores(name: str, prediction: Column, targets: Column) -> Column:
    """array of the scores of ``em``, ``f1`` or ``hit`` of each target."""
    if name == "f1":
        of = lambda p: lambda t: _let(_numbered(answer_tokens(t)), lambda b: token_f1(p, b))
        return _let(_numbered(answer_tokens(prediction)), lambda p: F.transform(targets, of(p)))
    tests = {"em": lambda p, t: normalize_answer(t) == p, "hit": lambda p, t: F.contains(p, normalize_answer(t))}
    return _let(normalize_answer(prediction), lambda p: F.transform(targets, lambda t: tests[name](p, t).cast("double")))


def aggregated_score(name: str, prediction: Column, targets: Column, aggregate: str = "max") -> Column:
    """The aggregate of a row's target scores, 0 without targets."""
    return F.coalesce(AGGREGATES[aggregate](target_scores(name, prediction, targets)), F.lit(0.0))


def exact_match(prediction: Column, targets: Column) -> Column:
    return _let(normalize_answer(prediction), lambda p: F.exists(targets, lambda t: normalize_answer(t) == p))


def em_score(prediction: Column, targets: Column) -> Column:
    return F.coalesce(exact_match(prediction, targets).cast("double"), F.lit(0.0))


def hit_score(prediction: Column, targets: Column) -> Column:
    """Whether a normalised target is within the normalised prediction; an empty one is."""
    hit = _let(normalize_answer(prediction), lambda p: F.exists(targets, lambda t: F.contains(p, normalize_answer(t))))
    return F.coalesce(hit.cast("double"), F.lit(0.0))


def _numbered(tokens: Column) -> Column:
    """Tokens of a multiset told apart: the first of equal ones keeps its name, the others get their number.

    Only repeated tokens, few as a rule, are looked up in the sorted list.
    """
    name = lambda s: lambda x, i: F.when(x == F.get(s, i - 1), F.concat_ws(" ", x, (i + 1 - F.array_position(s, x)).cast("string"))).otherwise(x)
    return _let(F.array_sort(tokens), lambda s: F.transform(s, name(s)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two numbered token sets, 0 if nothing is shared."""
    f1 = lambda n: F.when(n > 0, 2.0 * n / (F.size(a) + F.size(b))).otherwise(0.0)
    return _let(F.size(F.array_intersect(a, b)), f1)


def f1_score(prediction: Column, targets: Column) -> Column:
    of = lambda p: lambda t: _let(_numbered(answer_tokens(t)), lambda b: token_f1(p, b))
    best = _let(_numbered(answer_tokens(prediction)), lambda p: F.array_max(F.transform(targets, of(p))))
    return F.coalesce(best, F.lit(0.0))


METRICS = {"em": em_score, "f1": f1_score, "hit": hit_score}


def metric_columns(names: list[str], prediction: str = "prediction", targets: str = "targets", aggregate: str = "max") -> list[Column]:
    """Column of each named metric."""
    unknown = sorted(set(names) - set(METRICS))
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {aggregate}")
    p, t = F.col(prediction), F.col(targets)
    return [(METRICS[n](p, t) if aggregate == "max" else aggregated_score(n, p, t, aggregate)).alias(n) for n in names]


def metric_means(rows: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Means of the metrics, 0 for no rows, in one pass; ``by`` groups them, such as by response variant."""
    metric_columns(names)  # unknown names are an error
    # texts are normalised once for all metrics, to columns of tokens
    split = rows.select(*(by or []), answer_tokens(F.col("prediction")).alias("_p"), F.transform("targets", answer_tokens).alias("_t"))
    split = split.withColumns({"_pn": F.array_join("_p", " "), "_tn": F.transform("_t", lambda t: F.array_join(t, " "))})
    p, t, pn, tn = (F.col(c) for c in ("_p", "_t", "_pn", "_tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scores = {
        "em": zero(F.array_contains(tn, pn).cast("double")),
        "f1": zero(_let(_numbered(p), lambda a: F.array_max(F.transform(t, lambda x: _let(_numbered(x), lambda b: token_f1(a, b)))))),
        "hit": zero(F.exists(tn, lambda x: F.contains(pn, x)).cast("double")),
    }
    scored = split.select(*(by or []), *[scores[n].alias(n) for n in names])
    return scored.groupBy(*(by or [])).agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])


def l2_normalized(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


#: Vectors of a side of one cell, which a task holds in memory.
CELL_ROWS = 100_000


def retrieval_score(sources: DataFrame, targets: DataFrame, threshold: float = RETRIEVAL_THRESHOLD, blocks: int | None = None) -> DataFrame:
    """``id, best, hit`` of each source ``id, vector``: its greatest dot product with a target, and whether it exceeds
    the threshold.

    Sources and targets are dealt to a grid of ``blocks`` x ``blocks`` cells and each cell is one matrix product, so
    every side is copied ``blocks`` times and no pair becomes a row. By default cells have ``CELL_ROWS`` vectors of a
    side, and there are enough of them for the cores.
    """
    if blocks is None:
        rows = max(sources.count(), targets.count())
        blocks = max(1, -(-rows // CELL_ROWS), min(8, rows // 1000))
    cells = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    mine = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    a = sources.select(mine("id").alias("i"), cells.alias("j"), "id", "vector").repartition("i", "j")
    b = targets.select(cells.alias("i"), mine("id").alias("j"), "vector").repartition("i", "j")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "best": pa.array([], pa.float64())})
        x, y = (pc.list_flatten(t.column("vector").combine_chunks()).to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (left, right))
        best = np.full(len(x), -np.inf)
        for at in range(0, len(y), 1024):
            best = np.maximum(best, (x @ y[at : at + 1024].T).max(1))
        return pa.table({"id": left.column("id"), "best": pa.array(best)})

    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(run, "id long, best double")
    best = found.groupBy("id").agg(F.max("best").alias("best"))
    return sources.select("id").join(best, "id", "left").withColumn("hit", F.coalesce(F.col("best") > threshold, F.lit(False)))



def retrieval_share(found: DataFrame) -> DataFrame:
    """One row: share of the sources of ``retrieval_score`` with a hit."""
    return found.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("retrieval_score"))


def evaluate(metric: str, rows: DataFrame | None = None, aggregate: str = "max", **given: DataFrame) -> DataFrame:
    """One row with the named metric's mean: ``em``, ``f1`` or ``hit`` of ``rows``; ``retrieval_score`` of vectors
    ``sources`` and ``targets``; ``llm`` of a judge's ``judgements`` (``response``)."""
    if metric in METRICS:
        return rows.select(*metric_columns([metric], aggregate=aggregate)).agg(F.coalesce(F.avg(metric), F.lit(0.0)).alias(metric))
    if metric == "retrieval_score":
        return retrieval_share(retrieval_score(given["sources"], given["targets"]))
    if metric == "llm":
        yes = (normalize_answer(F.col("response")) == "yes").cast("double")
        return given["judgements"].agg(F.coalesce(F.avg(yes), F.lit(0.0)).alias("llm"))
    raise ValueError(f"unknown metric: {metric}")
