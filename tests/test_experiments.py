import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import experiments as E

LOG = "question_id string, true_hop int, recurrence_k int, adapter_control string, correct boolean, split string, pos long"


def test_intervals_hold_the_difference_and_signs_are_exact(spark):
    rng = random.Random(4)
    rows = [("far", f"q{i}", float(rng.random() < 0.3), float(rng.random() < 0.7)) for i in range(400)]
    rows += [("same", f"q{i}", x, x) for i in range(50) for x in [float(i % 2)]] + [("one", "q", 0.0, 1.0), ("none", "q", None, 1.0)]
    pairs = spark.createDataFrame(rows, "g string, key string, a double, b double")
    found = {r.g: r for r in E.paired_bootstrap(pairs, ["g"], 500).collect()}
    assert set(found) == {"far", "same", "one"}
    far = found["far"]
    d = [b - a for g, _, a, b in rows if g == "far"]
    assert far.difference == pytest.approx(sum(d) / 400) and far.low < far.difference < far.high
    # the interval's width is near that of the normal approximation
    sd = math.sqrt(sum((x - far.difference) ** 2 for x in d) / 399 / 400)
    assert (far.high - far.low) / (2 * 1.96 * sd) == pytest.approx(1, abs=0.15)
    n, k = far.wins + far.losses, min(far.wins, far.losses)
    assert far.p_sign == pytest.approx(min(1, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n), rel=1e-9)
    assert far.p_permutation == pytest.approx(1 / 501)
    assert (found["same"].low, found["same"].high, found["same"].p_sign, found["same"].p_permutation) == (0, 0, 1, 1)
    assert (found["one"].low, found["one"].high, found["one"].p_sign, found["one"].p_permutation) == (1, 1, 1, 1)
    # neither the partitioning nor the order of rows matters
    again = {r.g: r for r in E.paired_bootstrap(pairs.repartition(7), ["g"], 500).collect()}
    assert all(tuple(again[g])[1:] == pytest.approx(tuple(found[g])[1:], rel=1e-12) for g in found)


def test_replicates_are_not_rows(spark):
    pairs = spark.range(1000).select(F.col("id").alias("key"), F.lit(0.0).alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    plan = E.paired_bootstrap(pairs, [], 200)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_numbers_are_drawn_once_for_a_question(spark):
    """Of a hash's hex digits four are a number. All rows of a question are in one task, and tasks aren't merged by size."""
    digits = hashlib.md5(b"2026:boot:q:1").hexdigest()
    assert E.hash_draws(["p", "q"], 11, "boot")[1, 8:].tolist() == [int(digits[i : i + 4], 16) for i in (0, 4, 8)]
    pairs = spark.createDataFrame([(g, k, 0.0, 1.0) for g in "xyz" for k in map(str, range(40))], "g string, key string, a double, b double")
    sums = E._replicate_sums(pairs, ["g"], 8, E.SEED)
    assert sums.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = sorted((r.g, r.n, tuple(r._v[:8])) for r in sums.collect())
    assert [p[1:] for p in parts if p[0] == "x"] == [p[1:] for p in parts if p[0] == "z"] and sum(p[1] for p in parts) == 120


def test_seeds(spark):
    rows = [(s, seed, float(x)) for s, xs in {"none": [0, 0, 1], "correct": [1, 1, 1]}.items() for seed, x in enumerate(xs)] + [("lone", 9, 1.0)]
    df = spark.createDataFrame(rows, "system string, seed int, x double")
    found = {r.system: r for r in E.seed_summary(df, [], "system", "seed", F.col("x"), "none").collect()}
    assert found["correct"].p_seeds == 0.5 and found["none"].p_seeds is None and found["lone"].p_seeds is None
    assert (found["none"].n_seeds, found["none"].low, found["none"].high) == (3, 0, 1)
    assert found["none"].sd == pytest.approx(math.sqrt(1 / 3)) and found["lone"].sd is None


def test_generalisation_and_halting(spark):
    rows = [("a", 1, 1, None, True), ("a", 1, 4, None, True), ("b", 3, 1, None, False), ("b", 3, 4, None, True), ("c", 2, 1, None, False), ("d", None, 1, None, True)]
    log = spark.createDataFrame([(*r, None, i) for i, r in enumerate(rows)], LOG)
    by = {r.k: (r.hop_auc, r.extrapolation_gap) for r in E.hop_generalisation(log, (1, 2)).collect()}
    assert by == {1: (pytest.approx(1 / 3), 0.5), 4: (1.0, 0.0)}
    assert {r.hop: r.gain for r in E.compute_scaling(log, 1, 4).collect()} == {1: 0.0, 2: None, 3: 1.0}
    assert tuple(E.halting(log).first()) == (2, 0.5, 0.0, 0.5, 2.5)
    assert tuple(E.halting(log.limit(0)).first())[:2] == (0, None)


def test_sets_and_hits(spark):
    rows = [(["a", "b", "a"], ["b", "c", None]), ([], ["a"]), (["x"], []), (None, ["a"]), (["c", "a"], ["a"])]
    df = spark.createDataFrame(rows, "answers array<string>, gold array<string>")
    a, g = F.col("answers"), F.col("gold")
    found = [(r.s.precision, r.s.recall, r.s.f1, r.h1, r.h2) for r in df.select(E.set_scores(a, g).alias("s"), E.hits_at(a, g, 1).alias("h1"), E.hits_at(a, g, 2).alias("h2")).collect()]
    assert found == [(0.5, 0.5, 0.5, 0, 1), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0.5, 1, pytest.approx(2 / 3), 0, 1)]


def test_quantiles(spark):
    rng = random.Random(8)
    values = [("a", rng.lognormvariate(0, 1)) for _ in range(3000)] + [("b", 2.0)] * 5 + [("c", None)]
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    exact = {r.g: r for r in E.exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p99": 0.99, "least": 0.0}).collect()}
    own = sorted(v for g, v in values if g == "a")
    assert (exact["a"].p50, exact["a"].p99, exact["a"].least) == (own[1499], own[2969], own[0])
    assert exact["b"].p99 == 2.0 and set(exact) == {"a", "b"}
    parts = E.sketches(df.withColumn("run", F.spark_partition_id()), ["g", "run"], "v")
    near = {r.g: r for r in E.sketch_quantiles(E.merged_sketches(parts, ["g"]), {"p50": 0.5}).collect()}
    assert near["a"].n == 3000 and abs(sum(v < near["a"].p50 for v in own) / 3000 - 0.5) < 0.03
