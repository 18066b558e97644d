"""Queries on statistics of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import experiments as E
from graphloom.operators import rules as R
from graphloom.plans import Scratch
from graphloom.sources import table

from .registry import query
from .views import KG_SMALL, PRED_LOG, QA_PAIRS, kg_small, pred_log, qa_pairs

REPLICATES = 1000
_DEFAULTED = f"{PRED_LOG}, d AS (SELECT *, coalesce(adapter_control, 'correct') AS system FROM pred_log)"
_MEANS = """m AS (SELECT recurrence_k % 2 AS k, question_id AS key, system, avg(correct::INT) AS score FROM d GROUP BY ALL),
pairs AS (SELECT x.k, x.system, x.key, y.score AS a, x.score AS b FROM m x JOIN m y ON y.k = x.k AND y.key = x.key AND y.system = 'none' WHERE x.system <> 'none')"""
_HEX4 = "('0x' || md5('2026:{0}:' || key || ':' || (r // 8))[(r % 8) * 4 + 1:(r % 8) * 4 + 4])::INT"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"""WITH {_DEFAULTED}, {_MEANS}, t AS (SELECT k, system, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, sum(b - a) AS total, count(*) FILTER (b > a) AS wins, count(*) FILTER (b < a) AS losses FROM pairs GROUP BY k, system),
u AS (SELECT k, system, r, b - a AS d, {_HEX4.format('boot')} AS u, {_HEX4.format('sign')} AS s FROM pairs, range({REPLICATES}) AS x(r)),
w AS (SELECT *, {' + '.join(f'(u >= {t})::INT' for t in E.POISSON_STEPS)} AS w FROM u),
reps AS (SELECT k, system, r, sum(w) AS w, sum(w * d) AS wd, sum(CASE WHEN s < 32768 THEN d ELSE -d END) AS flip FROM w GROUP BY k, system, r),
q AS (SELECT reps.k, reps.system, quantile_cont(CASE WHEN w > 0 THEN wd / w END, 0.025) AS low, quantile_cont(CASE WHEN w > 0 THEN wd / w END, 0.975) AS high,
        (1 + count(*) FILTER (round(abs(flip), 9) >= round(abs(total), 9))) / {REPLICATES + 1}.0::DOUBLE AS p FROM reps JOIN t ON t.k = reps.k AND t.system = reps.system GROUP BY reps.k, reps.system)
SELECT t.k, t.system, n, round(mean_a, 9) AS mean_a, round(mean_b, 9) AS mean_b, round(total / n, 9) AS difference, round(low, 9) AS low, round(high, 9) AS high, wins, losses,
  round(least(1.0::DOUBLE, 2 * list_sum([exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)) FOR i IN range(0, least(wins, losses) + 1)])) + 1e-12::DOUBLE, 9) AS p_sign,
  round(p, 9) AS p_permutation FROM t JOIN q ON t.k = q.k AND t.system = q.system""")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Controls against no adapter on the same questions, for odd and even depths."""
    log = E.with_defaults(pred_log(spark, sf)).withColumn("k", F.col("recurrence_k") % 2)
    pairs = E.paired(log, "question_id", "adapter_control", F.col("correct").cast("double"), "none", ["k"])
    found = E.paired_bootstrap(pairs, ["k", "system"], REPLICATES)
    # p_sign is a multiple of a power of a half, and may lie just between two rounded values
    return _rounded(found.withColumn("p_sign", F.col("p_sign") + 1e-12), "mean_a", "mean_b", "difference", "low", "high", "p_sign", "p_permutation")


@query(f"""WITH RECURSIVE {_DEFAULTED}, m AS (SELECT recurrence_k AS k, system, pos % 5 AS seed, avg(correct::INT) AS score FROM d GROUP BY ALL),
x AS (SELECT m.k, m.system, m.seed, m.score, CASE WHEN m.system <> 'none' THEN m.score - o.score END AS d FROM m LEFT JOIN m o ON o.k = m.k AND o.seed = m.seed AND o.system = 'none'),
g AS (SELECT k, system, count(*) AS n_seeds, avg(score) AS mean, stddev_samp(score) AS sd, min(score) AS low, max(score) AS high, list(d ORDER BY d) FILTER (d IS NOT NULL) AS d FROM x GROUP BY k, system),
p AS (SELECT k, system, b, list_sum([d[i + 1] * CASE WHEN (b >> i) & 1 = 1 THEN 1 ELSE -1 END FOR i IN range(len(d))]) AS t, list_sum(d) AS total FROM g, range(32) AS y(b) WHERE b < 1 << len(d)),
s AS (SELECT k, system, count(*) FILTER (round(abs(t), 9) >= round(abs(total), 9)) / count(*) AS p FROM p GROUP BY k, system)
SELECT g.k, g.system, n_seeds, round(mean, 9) AS mean, round(sd, 9) AS sd, round(low, 9) AS low, round(high, 9) AS high, round(p, 9) AS p_seeds FROM g LEFT JOIN s ON s.k = g.k AND s.system = g.system""")
def seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Five seeds of each control and depth."""
    log = E.with_defaults(pred_log(spark, sf)).withColumns({"k": F.col("recurrence_k"), "seed": F.col("pos") % 5})
    return _rounded(E.seed_summary(log, ["k"], "adapter_control", "seed", F.col("correct").cast("double"), "none"), "mean", "sd", "low", "high", "p_seeds")


@query(f"""WITH {_DEFAULTED}, f AS (SELECT system AS control, recurrence_k AS k, true_hop, count(*) AS n, sum(correct::INT) AS good FROM d WHERE true_hop >= 1 GROUP BY ALL)
SELECT control, k, round(avg(good / n), 9) AS hop_auc, round(sum(good) FILTER (true_hop IN (1, 2)) / sum(n) FILTER (true_hop IN (1, 2)) - sum(good) FILTER (true_hop NOT IN (1, 2)) / sum(n) FILTER (true_hop NOT IN (1, 2)), 9) AS extrapolation_gap
FROM f GROUP BY control, k""")
def hop_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.hop_generalisation(pred_log(spark, sf), (1, 2)), "hop_auc", "extrapolation_gap")


@query(f"""WITH {_DEFAULTED} SELECT system AS control, true_hop AS hop, round(avg(correct::INT) FILTER (recurrence_k = 4) - avg(correct::INT) FILTER (recurrence_k = 1), 9) AS gain FROM d WHERE true_hop >= 1 GROUP BY ALL""")
def compute_scaling_gain(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.compute_scaling(pred_log(spark, sf), 1, 4), "gain")


@query(f"""WITH {PRED_LOG}, own AS (SELECT * FROM pred_log WHERE coalesce(adapter_control, 'correct') = 'correct'),
best AS (SELECT question_id, arg_max(true_hop, pos) FILTER (WHERE true_hop IS NOT NULL) AS h, min(recurrence_k) FILTER (WHERE correct) AS b FROM own GROUP BY question_id)
SELECT count(*) AS n, round(avg(abs(b - h)), 9) AS halt_mae, round(avg((b < h)::INT), 9) AS early_stop, round(avg((b > h)::INT), 9) AS overthinking, round(avg(b), 9) AS mean_k FROM best WHERE b IS NOT NULL AND h >= 1""")
def halt_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.halting(pred_log(spark, sf)), "halt_mae", "early_stop", "overthinking", "mean_k")


_LISTS = f"{QA_PAIRS}, l AS (SELECT id, string_split(prediction, ' ') AS a, string_split(question, ' ') AS g FROM qa_pairs), x AS (SELECT *, list_distinct(a) AS da, list_distinct(g) AS dg FROM l)"


@query(f"""WITH {_LISTS}, s AS (SELECT *, len(list_intersect(da, dg)) AS n FROM x)
SELECT id, round(n / len(da), 9) AS precision, round(n / len(dg), 9) AS recall, round(2 * n / (len(da) + len(dg)), 9) AS f1, list_contains(g, a[1])::INT::DOUBLE AS hits_1, list_has_any(a[1:5], g)::INT::DOUBLE AS hits_5 FROM s""")
def set_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The words of an answer as a ranked list of answers, those of the question as the gold ones."""
    a, g = F.split("prediction", " "), F.split("question", " ")
    rows = qa_pairs(spark, sf).select("id", E.set_scores(a, g).alias("s"), E.hits_at(a, g, 1).alias("hits_1"), E.hits_at(a, g, 5).alias("hits_5"))
    return _rounded(rows.select("id", "s.*", "hits_1", "hits_5"), "precision", "recall", "f1")


@query(f"""WITH {KG_SMALL}, a AS (SELECT DISTINCT rel, src, dst FROM kg_small WHERE idx % 3 <> 0), g AS (SELECT DISTINCT rel, src, dst FROM kg_small)
SELECT g.rel AS graph, count(*) AS n_gold, count(a.src) AS n_covered, round(count(a.src) / count(*), 9) AS coverage FROM g LEFT JOIN a ON a.rel = g.rel AND a.src = g.src AND a.dst = g.dst GROUP BY g.rel""")
def triple_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A prediction that names two of three triples of each relation."""
    gold = kg_small(spark, sf).withColumn("graph", F.col("rel"))
    return _rounded(E.triple_coverage(gold.filter("idx % 3 <> 0"), gold, ["graph"]), "coverage")


_QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@query("""WITH r AS (SELECT event_type AS control, abs(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY abs(value)) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT control, n, """ + ", ".join(f"max(v) FILTER (i = greatest(ceil({p} * n), 1)) AS {k}" for k, p in _QUANTILES.items()) + """, max(v) AS peak, true AS sketch_agrees FROM r GROUP BY control, n""")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles beside those of sketches kept for each of 16 runs and merged: their ranks differ by 3 % at most."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("control"), (F.col("event_id") % 16).alias("run"), F.abs("value").alias("latency"))
    runs = Scratch(spark, "latency").save(E.sketches(rows, ["control", "run"], "latency"), "sketches")
    near = E.sketch_quantiles(E.merged_sketches(runs, ["control"]), {f"s_{k}": p for k, p in _QUANTILES.items()})
    exact = E.exact_quantiles(rows, ["control"], "latency", _QUANTILES)
    ranks = rows.filter("latency IS NOT NULL").join(near.drop("n"), "control").groupBy("control").agg(
        F.max("latency").alias("peak"), F.count("*").alias("_n"), *[F.count(F.when(F.col("latency") < F.col(f"s_{k}"), 1)).alias(f"b_{k}") for k in _QUANTILES], *[F.count(F.when(F.col("latency") <= F.col(f"s_{k}"), 1)).alias(f"u_{k}") for k in _QUANTILES]
    )
    agrees = F.lit(True)
    for k, p in _QUANTILES.items():
        agrees = agrees & (F.col(f"b_{k}") <= (p + 0.03) * F.col("_n")) & (F.col(f"u_{k}") >= (p - 0.03) * F.col("_n"))
    return exact.join(ranks, "control").select("control", "n", *_QUANTILES, "peak", agrees.alias("sketch_agrees"))


#: Customers live in nations, which are part of regions; two thirds are also in their region, and nations are home of half of them.
_RULE_GRAPH = """g AS (SELECT 'C' || c_custkey AS src, 'lives_in' AS rel, 'N' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'N' || c_nationkey, 'home_of', 'C' || c_custkey FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'C' || c_custkey, 'in_region', 'R' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0
  UNION ALL SELECT 'N' || n_nationkey, 'part_of', 'R' || n_regionkey FROM nation)"""
_RULES = f"""{_RULE_GRAPH}, sz AS (SELECT rel, count(*) AS n FROM g GROUP BY rel),
inv AS (SELECT a.rel AS r1, b.rel AS head, count(*) AS support FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src GROUP BY ALL),
two AS (SELECT a.rel AS r1, b.rel AS r2, a.src AS x, b.dst AS z FROM g a JOIN g b ON a.dst = b.src WHERE a.src <> b.dst),
tot AS (SELECT r1, r2, count(*) AS n FROM two GROUP BY ALL), com AS (SELECT r1, r2, g.rel AS head, count(*) AS support FROM two JOIN g ON g.src = x AND g.dst = z GROUP BY ALL),
rules AS (SELECT 'inverse' AS kind, r1, NULL::VARCHAR AS r2, head, support, n AS total, support / n AS confidence FROM inv JOIN sz ON sz.rel = r1
  UNION ALL SELECT 'composition', com.r1, com.r2, head, support, n, support / n FROM com JOIN tot ON tot.r1 = com.r1 AND tot.r2 = com.r2)"""


def _rule_graph(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    name = lambda prefix, k: F.concat(F.lit(prefix), F.col(k).cast("string"))
    edge = lambda df, src, rel, dst: df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    customer, nation, home, region = name("C", "c_custkey"), name("N", "n_nationkey"), name("N", "c_nationkey"), name("R", "n_regionkey")
    placed = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    parts = [edge(c, customer, "lives_in", home), edge(c.filter("c_custkey % 2 = 0"), home, "home_of", customer), edge(placed.filter("c_custkey % 3 <> 0"), customer, "in_region", region), edge(n, nation, "part_of", region)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(f"WITH {_RULES} SELECT kind, r1, r2, head, support, total, round(confidence, 9) AS confidence FROM rules")
def relation_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.relation_rules(_rule_graph(spark, sf)), "confidence")


@query(f"""WITH {_RULES}, q AS (SELECT 'r' || c_custkey AS question_id, 'C' || c_custkey AS source, 'R' || n_regionkey AS target, 'in_region' AS answer, 2 + c_custkey % 2 AS true_hop FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'n' || c_custkey, 'C' || c_custkey, 'N' || c_nationkey, 'lives_in', 2 FROM customer),
good AS (SELECT * FROM rules WHERE support >= 2 AND confidence >= 0.5)
SELECT question_id, EXISTS (SELECT 1 FROM g WHERE src = source AND dst = target) AS direct, EXISTS (SELECT 1 FROM g WHERE src = target AND dst = source) AS inverse,
  EXISTS (SELECT 1 FROM customer WHERE 'n' || c_custkey = question_id AND c_custkey % 5 = 0) AS described,
  EXISTS (SELECT 1 FROM g JOIN good ON kind = 'inverse' AND r1 = g.rel AND head = answer WHERE true_hop > 1 AND g.src = target AND g.dst = source)
  OR EXISTS (SELECT 1 FROM g a JOIN g b ON a.dst = b.src JOIN good ON kind = 'composition' AND r1 = a.rel AND r2 = b.rel AND head = answer WHERE true_hop > 2 AND a.src = source AND b.dst = target) AS equivalent FROM q""")
def shortcut_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Questions on regions and nations of customers; texts of every fifth customer contain its nation's name."""
    graph, c, n = _rule_graph(spark, sf), table(spark, sf, "customer"), table(spark, sf, "nation")
    key = F.col("c_custkey").cast("string")
    name = lambda prefix, k: F.concat(F.lit(prefix), F.col(k).cast("string"))
    asked = lambda kind, target, answer, hop: F.struct(F.concat(F.lit(kind), key).alias("question_id"), F.concat(F.lit("C"), key).alias("source"), target.alias("target"), F.lit(answer).alias("answer"), hop.cast("long").alias("true_hop"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    both = F.array(asked("r", name("R", "n_regionkey"), "in_region", 2 + F.col("c_custkey") % 2), asked("n", name("N", "c_nationkey"), "lives_in", F.lit(2)))
    q = rows.select(F.explode(both).alias("q")).select("q.*")
    # each fifth customer has a text that contains its nation's
    text = F.when(F.col("c_custkey") % 5 == 0, F.concat("n_name", F.lit(" old"))).otherwise(F.lit("someone"))
    texts = rows.select(F.concat(F.lit("C"), key).alias("entity"), text.alias("text")).unionAll(n.select(name("N", "n_nationkey").alias("entity"), F.upper("n_name").alias("text")))
    return R.shortcut_checks(q, graph, R.relation_rules(graph), texts)
