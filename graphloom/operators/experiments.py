"""Statistics of experiments: paired comparisons, seeds, generalisation over hops, halting, latencies, sets of answers.

Resampling copies no row. A question's weights in all replicates are one array from hashes of question and replicate,
drawn once for all rows of the question, and a vector sum over the questions gives all replicates in one aggregate,
combined before the shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.analysis import best_depths, with_defaults
from graphloom.plans import dense_index_by

#: 65536 times the distribution function of Poisson's law of mean 1 at 0, 1, ..., 7.
POISSON_STEPS = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)
SEED = 2026
#: Groups whose sums a task holds at once.
MAX_HELD = 256
#: Seeds whose sign patterns are all tried.
MAX_SEEDS = 16


def hash_draws(keys: list[str | None], n: int, scope: str, seed: int = SEED) -> np.ndarray:
    """A row for each key of ``n`` numbers below 65536 from the hashes of ``seed:scope:key:block``, eight a block."""
    names = [f"{seed}:{scope}:" + ("" if k is None else f"{k}:") for k in keys]
    hashes = b"".join(hashlib.md5(f"{name}{block}".encode()).digest() for name in names for block in range((n - 1) // 8 + 1))
    return np.frombuffer(hashes, ">u2").reshape(len(keys), -1)[:, :n]


def paired(rows: DataFrame, key: str, system: str, score: Column, baseline: str, by: list[str]) -> DataFrame:
    """``*by, key, system, a, b``: for each system but the baseline the mean scores of a question under it (``b``) and
    under the baseline (``a``), where both are there. One shuffle of partial means and a join on them."""
    means = rows.groupBy(*by, F.col(key).alias("key"), F.col(system).alias("system")).agg(F.avg(score).alias("score"))
    base = means.filter(F.col("system") == baseline).select(*by, "key", F.col("score").alias("a"))
    return means.filter(F.col("system") != baseline).withColumnRenamed("score", "b").join(base, [*by, "key"])


@F.pandas_udf(T.DoubleType())
def sign_test(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Exact two-sided sign test; the terms of the binomial tail shrink from its edge, so few are summed."""

    def p(w: int, v: int) -> float:
        n, k = w + v, min(w, v)
        edge = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
        total = term = 1.0
        for i in range(k, 0, -1):
            term *= i / (n - i + 1)
            total += term
            if term < 1e-17 * total:
                break
        return min(1.0, 2 * math.exp(edge) * total)

    return pd.Series([p(int(w), int(v)) for w, v in zip(wins, losses, strict=True)])


def _quantile(values: str, p: float) -> str:
    """SQL of the interpolated quantile of a sorted array."""
    at = f"({p} * (size({values}) - 1))"
    low = f"get({values}, CAST(floor({at}) AS INT))"
    return f"({low} + ({at} - floor({at})) * (get({values}, CAST(ceil({at}) AS INT)) - {low}))"


def _replicate_sums(pairs: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """``*by, n, sum_a, sum_b, _t, wins, losses, _v`` of parts of each group: counts, sums, and as one array the replicates'
    sums of weights, of weighted differences and of differences with random signs.

    A task has all rows of a question, so that its numbers are drawn once. The number of tasks is set, as by the size of its
    rows alone the work would be left to a few.
    """
    kinds = [T.StructField(g, pairs.schema[g].dataType) for g in by]
    names = ["n", "sum_a", "sum_b", "_t", "wins", "losses"]
    types = [T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.LongType(), T.ArrayType(T.DoubleType())]
    schema = T.StructType([*kinds, *(T.StructField(n, t) for n, t in zip([*names, "_v"], types, strict=True))])
    weights = np.searchsorted(POISSON_STEPS, np.arange(65536), "right").astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), group_types, strict=True)]
            counts = np.array([c for c, _ in held.values()])
            columns += [pa.array(counts[:, k].astype(np.int64) if n in ("n", "wins", "losses") else counts[:, k]) for k, n in enumerate(names)]
            columns.append(pa.array([v for _, v in held.values()], pa.list_(pa.float64())))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, [*by, *names, "_v"])

        for whole in batches:
            group_types = [whole.schema.field(g).type for g in by]
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                keys = b.column("key").to_pylist()
                place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                mine = np.array([place[k] for k in keys])
                w = weights[hash_draws(list(place), replicates, "boot", seed)]
                s = np.where(hash_draws(list(place), replicates, "sign", seed) < 32768, 1.0, -1.0)
                x, y = (b.column(c).to_numpy() for c in "ab")
                d = y - x
                groups: dict[tuple, list[int]] = {}
                for i, g in enumerate(zip(*(b.column(g).to_pylist() for g in by), strict=True) if by else repeat((), len(keys))):
                    groups.setdefault(g, []).append(i)
                for g, i in groups.items():
                    at_, e = mine[i], d[i]
                    counts = np.array([len(i), x[i].sum(), y[i].sum(), e.sum(), (e > 0).sum(), (e < 0).sum()], np.float64)
                    sums = np.concatenate([w[at_].sum(0), e @ w[at_], e @ s[at_]])
                    before = held.get(g)
                    held[g] = (before[0] + counts, before[1] + sums) if before else (counts, sums)
                if len(held) > MAX_HELD:
                    yield rows()
        if held:
            yield rows()

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(*by, F.col("key").cast("string").alias("key"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    return given.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def paired_bootstrap(pairs: DataFrame, by: list[str], replicates: int = 1000, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """For each group of ``pairs`` (``key, a, b``): ``n, mean_a, mean_b, difference``, its percentile interval ``low``
    to ``high`` over Poisson replicates, ``wins`` and ``losses`` of b, the exact ``p_sign``, and ``p_permutation`` by
    random signs. A replicate without any weight is left out. No group gives no row."""
    sums = _replicate_sums(pairs, by, replicates, seed).groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum("sum_a") / F.sum("n")).alias("mean_a"), (F.sum("sum_b") / F.sum("n")).alias("mean_b"), F.sum("_t").alias("_t"),
        F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), Summarizer.sum(array_to_vector("_v")).alias("_v"),
    )
    sums = sums.withColumn("_v", vector_to_array("_v"))
    means = f"array_sort(filter(zip_with(slice(_v, 1, {replicates}), slice(_v, {replicates + 1}, {replicates}), (w, s) -> IF(w > 0, s / w, NULL)), x -> x IS NOT NULL))"
    # sums of a question's scores in other orders may differ in the last digits
    beyond = f"size(filter(slice(_v, {2 * replicates + 1}, {replicates}), t -> round(abs(t), 9) >= round(abs(_t), 9)))"
    tail = (1 - level) / 2
    return sums.withColumn("_m", F.expr(means)).select(
        *by, "n", "mean_a", "mean_b", (F.col("_t") / F.col("n")).alias("difference"), F.expr(_quantile("_m", tail)).alias("low"), F.expr(_quantile("_m", 1 - tail)).alias("high"),
        "wins", "losses", sign_test("wins", "losses").alias("p_sign"), F.expr(f"(1 + {beyond}) / {replicates + 1}.0D").alias("p_permutation"),
    )


def seed_summary(rows: DataFrame, by: list[str], system: str, seed: str, score: Column, baseline: str) -> DataFrame:
    """``*by, system, n_seeds, mean, sd, low, high`` of a system's means by seed, and ``p_seeds``: the share of all sign
    patterns of the seeds' differences to the baseline whose sum is as far from 0 as theirs, null for the baseline and
    without common seeds. At most ``MAX_SEEDS`` seeds, else an error."""
    means = rows.groupBy(*by, F.col(system).alias("system"), F.col(seed).alias("seed")).agg(F.avg(score).alias("score"))
    base = means.filter(F.col("system") == baseline).select(*by, "seed", F.col("score").alias("base"))
    both = means.join(base, [*by, "seed"], "left")
    d = F.when(F.col("system") != baseline, F.col("score") - F.col("base"))
    found = both.groupBy(*by, "system").agg(
        F.count("*").alias("n_seeds"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.min("score").alias("low"), F.max("score").alias("high"),
        F.array_sort(F.collect_list(d)).alias("_d"),
    )
    signs = "aggregate(sequence(0, size(_d) - 1), 0D, (t, i) -> t + IF(shiftright(m, i) & 1 = 1, 1D, -1D) * get(_d, i))"
    total = "aggregate(_d, 0D, (t, x) -> t + x)"
    patterns = "CAST(shiftleft(1, size(_d)) AS INT)"
    share = f"size(filter(sequence(0, {patterns} - 1), m -> round(abs({signs}), 9) >= round(abs({total}), 9))) / {patterns}"
    guard = f"IF(size(_d) > {MAX_SEEDS}, raise_error('more than {MAX_SEEDS} seeds'), IF(size(_d) = 0, NULL, {share}))"
    return found.withColumn("p_seeds", F.expr(guard)).drop("_d")


def hop_generalisation(log: DataFrame, seen: tuple[int, ...]) -> DataFrame:
    """``control, k, hop_auc, extrapolation_gap`` of a prediction log: the mean of the hops' accuracies, and accuracy on
    ``seen`` hops less that on the others (null if one of them has no row)."""
    hop = F.col("true_hop")
    fine = with_defaults(log).filter("true_hop >= 1").groupBy(F.col("adapter_control").alias("control"), F.col("recurrence_k").alias("k"), "true_hop").agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("good")
    )
    part = lambda test: F.try_divide(F.sum(F.when(test, F.col("good"))), F.sum(F.when(test, F.col("n"))))
    return fine.groupBy("control", "k").agg(F.avg(F.col("good") / F.col("n")).alias("hop_auc"), (part(hop.isin(*seen)) - part(~hop.isin(*seen))).alias("extrapolation_gap"))


def compute_scaling(log: DataFrame, from_k: int, to_k: int) -> DataFrame:
    """``control, hop, gain``: accuracy at depth ``to_k`` less that at ``from_k``, null without rows of both."""
    at = lambda k: F.avg(F.when(F.col("recurrence_k") == k, F.col("correct").cast("double")))
    rows = with_defaults(log).filter("true_hop >= 1")
    return rows.groupBy(F.col("adapter_control").alias("control"), F.col("true_hop").alias("hop")).agg((at(to_k) - at(from_k)).alias("gain"))


def halting(log: DataFrame) -> DataFrame:
    """One row over the solved questions of known hop: ``n, halt_mae, early_stop, overthinking, mean_k``, by the least depth that succeeds."""
    found = best_depths(log).filter("best_k IS NOT NULL AND true_hop >= 1")
    rate = lambda test: F.avg(F.expr(test).cast("double"))
    return found.agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("best_k") - F.col("true_hop"))).alias("halt_mae"), rate("best_k < true_hop").alias("early_stop"),
        rate("best_k > true_hop").alias("overthinking"), F.avg("best_k").alias("mean_k"),
    )


def set_scores(answers: Column, gold: Column) -> Column:
    """struct of ``precision, recall, f1`` of two lists as sets; nulls are no members, an empty side scores 0."""
    a, g = F.array_distinct(F.array_compact(answers)), F.array_distinct(F.array_compact(gold))
    shared = F.size(F.array_intersect(a, g))
    share = lambda n, of: F.coalesce(F.when(of > 0, n / of), F.lit(0.0))
    return F.struct(share(shared, F.size(a)).alias("precision"), share(shared, F.size(g)).alias("recall"), share(2 * shared, F.size(a) + F.size(g)).alias("f1"))


def hits_at(answers: Column, gold: Column, k: int) -> Column:
    """1.0 if one of the first ``k`` ranked answers is a gold one."""
    return F.coalesce(F.arrays_overlap(F.array_compact(F.slice(answers, 1, k)), F.array_compact(gold)).cast("double"), F.lit(0.0))


def triple_coverage(answered: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """``*by, n_gold, n_covered, coverage``: share of a group's different gold triples (``src, rel, dst``) that were answered."""
    triple = [*by, "src", "rel", "dst"]
    said = answered.select(*triple).distinct().withColumn("_said", F.lit(1))
    rows = gold.select(*triple).distinct().join(said, triple, "left")
    return rows.groupBy(*by).agg(F.count("*").alias("n_gold"), F.count("_said").alias("n_covered"), (F.count("_said") / F.count("*")).alias("coverage"))


def sketches(rows: DataFrame, by: list[str], value: str, k: int = 200) -> DataFrame:
    """``*by, n, sketch``: mergeable quantile sketches, a table that later runs can be merged with."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of several runs as one for each group."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketch: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Adds a column for each named quantile and drops the sketch."""
    return sketch.withColumns({n: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for n, p in probabilities.items()}).drop("sketch")


def exact_quantiles(rows: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """``*by, n`` and a column for each named quantile, the value of rank ceil(p n). Groups are numbered over range
    partitions, so none is sorted in one task."""
    known = rows.filter(F.col(value).isNotNull()).select(*by, value)
    numbered = dense_index_by(known, by, "_at", [value])
    sizes = known.groupBy(*by).agg(F.count("*").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) - 1).alias("at")) for k, p in probabilities.items()])).alias("q")
    ranks = sizes.select(*by, "n", wanted).select(*by, "n", "q.name", F.col("q.at").alias("_at"))
    found = ranks.join(numbered, [*by, "_at"])
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in probabilities])
