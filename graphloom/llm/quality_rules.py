"""Quality rules: fixed base rules and robust multivariate outliers.

The transformed statistics of a text (``STYLES``) are a vector. For each language
and source the minimum covariance determinant (MCD) estimates location and
scatter from the h = 75 % of documents whose scatter has the least determinant.
A document is rejected if its Mahalanobis distance from the estimate of its group
exceeds a chi-square quantile.

1. Statistics of a text of n words scatter as 1 + ``NOISE_WORDS`` / n, so squared
   distances are taken times n / (n + ``NOISE_WORDS``).
2. Each group has three deterministic starts around its medians: the correlations
   of tanh-bounded coordinates, of spatial signs, and none, each with the
   quartiles' scales. From each, C-steps take the h documents of least distance
   and estimate anew; after ``FIRST_STEPS`` the start of least determinant goes on
   until its determinant stops falling.
3. The same estimates are made for each language and for all documents. A group's
   location and scatter are pooled with its language's, and these with those of
   all, as if ``POOL_ROWS`` documents came from there. So a group of any size has
   an estimate of its own, without a least size.

Estimates are over all documents that pass the base rules; those of one group
with equal statistics, which copies have, count once. Sums are by group and bin
of distance with map-side partial sums, so a group of any size is never in one
task; of the bin in which the h-th document lies its share is taken. The only
floor is numerical, ``GUARD`` of a coordinate's variance over all documents.

Null languages and sources are groups of their own. Null and empty texts have no
words and fail the base rules, as does any text of fewer than 50 words; texts of
any length are read whole. An empty table gives an empty result; repeated rows
and ties get equal verdicts. Extra columns pass through ``keep_good`` whatever
their names; ``quality_digest`` doesn't read them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.textstats import COUNTS, STYLES, styles, with_stats
from graphloom.plans import Scratch

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CORE_SHARE = 0.75
FIRST_STEPS = 2
#: C-steps end when the log of the determinant falls by less.
TOLERANCE = 1e-3
NOISE_WORDS = 400
POOL_ROWS = 50
GUARD = 1e-6
FEW_GROUPS = 4_000
#: Chance of a normal vector to be rejected. Statistics of clean texts have heavier tails, hence so small a chance.
TAIL = 1e-10
P = len(STYLES)
STARTS = ("tanh", "sign", "scale")
_BINS_PER_OCTAVE = 16
_LEAST_DISTANCE = 2.0**-20
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi2_cdf(x: float, k: float) -> float:
    """Distribution function of chi-square with ``k`` degrees of freedom, by the series of the incomplete gamma."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, k: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


CUTOFF = chi2_quantile(1 - TAIL, P)
#: Makes the scatter of the core of a normal group that of the group.
_CONSISTENT = CORE_SHARE / chi2_cdf(chi2_quantile(CORE_SHARE, P), P + 2)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def group_keys() -> Column:
    """Groups of a document, the narrowest first."""
    lang, source = (F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("="), c)) for c in ("lang", "source"))
    return F.array(F.concat(F.lit("2"), F.to_json(F.array(lang, source))), F.concat(F.lit("1"), lang), F.lit("0"))


def steadiness() -> Column:
    """Factor of squared distances by a text's length."""
    return F.col("n_words") / (F.col("n_words") + NOISE_WORDS)


def squared_distance() -> Column:
    """Of ``vector`` from ``location`` under ``precision``, times ``steadiness``."""
    z = [F.col("vector")[i] - F.col("location")[i] for i in range(P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + z[i] * z[j] * F.col("precision")[i * P + j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0)) * F.col("steady")


def symmetric(upper: np.ndarray) -> np.ndarray:
    """Matrix from its upper triangle by rows."""
    out = np.zeros((P, P))
    for (i, j), v in zip(_PAIRS, upper, strict=True):
        out[i, j] = out[j, i] = v
    return out


def estimate(total: float, weight: float, sums: np.ndarray, products: np.ndarray, guard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(location, scatter) from the number, the sum of factors and the weighted sums of a core."""
    location = sums / weight
    scatter = symmetric(products) - weight * np.outer(location, location)
    return location, _CONSISTENT * scatter / total + np.diag(guard)


def start_scatters(n: float, scale: np.ndarray, tanh: np.ndarray, tanh2: np.ndarray, sign2: np.ndarray, guard: np.ndarray) -> list[np.ndarray]:
    """Scatters of ``STARTS`` from sums of tanh-bounded coordinates and of products of these and of spatial signs."""
    out = []
    for moment in (symmetric(tanh2) / n - np.outer(tanh, tanh) / n**2, symmetric(sign2) / n, np.eye(P)):
        size = np.sqrt(np.maximum(np.diag(moment), 1e-12))
        correlation = moment / np.outer(size, size)
        # a share of the identity keeps starts of few documents regular
        correlation = 0.99 * correlation + 0.01 * np.eye(P)
        out.append(correlation * np.outer(scale, scale) + np.diag(guard))
    return out


_FIT = "group string, start int, n_rows long, location array<double>, scatter array<double>, precision array<double>, log_det double, done boolean"


def _fit_row(group: str, start: int, n: int, location: np.ndarray, scatter: np.ndarray, log_det: float, done: bool) -> tuple:
    return group, start, n, location.tolist(), scatter.ravel().tolist(), np.linalg.inv(scatter).ravel().tolist(), log_det, done


def _fits(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _FIT.split(", ")])


def _join_groups(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the written table ``groups``. Up to ``FEW_GROUPS`` rows of less than 1 kB each are
    broadcast, so that a hot group isn't dealt to one task; more are joined by size, where adaptive execution splits it."""
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, "group", how)


def _starts(rows: DataFrame, guard: np.ndarray, scratch: Scratch) -> DataFrame:
    """Fits to start from, of every group."""
    quartiles = [F.percentile(F.round(F.col("vector")[i], 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(P)]
    medians = rows.groupBy("group").agg(F.count("*").alias("n_rows"), *quartiles)
    scales = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(float(np.sqrt(guard[i])))) for i in range(P)]
    medians = medians.select("group", "n_rows", F.array(*[F.col(f"q{i}")[1] for i in range(P)]).alias("location"), F.array(*scales).alias("scale"))
    medians = scratch.save(medians, "medians")
    z = [((F.col("vector")[i] - F.col("location")[i]) / F.col("scale")[i]).alias(f"z{i}") for i in range(P)]
    around = _join_groups(rows, medians.drop("n_rows")).select("group", *z)
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))), F.lit(1e-12))
    around = around.select("group", *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(P)], *[(F.col(f"z{i}") / norm).alias(f"u{i}") for i in range(P)])
    names = [*(f"t{i}" for i in range(P)), *(f"t{i}{j}" for i, j in _PAIRS), *(f"u{i}{j}" for i, j in _PAIRS)]
    terms = [*(F.col(f"t{i}") for i in range(P)), *(F.col(f"{k}{i}") * F.col(f"{k}{j}") for k in "tu" for i, j in _PAIRS)]
    sums = around.groupBy("group").agg(*[F.sum(t).alias(k) for t, k in zip(terms, names, strict=True)])
    n = len(_PAIRS)
    sums = sums.select("group", *(F.array(*x).alias(k) for x, k in ((names[:P], "tanh"), (names[P : P + n], "tanh2"), (names[P + n :], "sign2"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                scatters = start_scatters(r.n_rows, *(np.array(x) for x in (r.scale, r.tanh, r.tanh2, r.sign2)), guard)
                out += [_fit_row(r.group, k, r.n_rows, np.array(r.location), s, math.inf, False) for k, s in enumerate(scatters)]
            yield _fits(out)

    return scratch.save(medians.join(sums, "group").mapInPandas(run, _FIT), "starts")


def _c_step(rows: DataFrame, fit: DataFrame, guard: np.ndarray) -> DataFrame:
    """The fits after a C-step; a fit whose determinant doesn't fall by ``TOLERANCE`` is done and keeps the lesser one."""
    v, w = F.col("vector"), F.col("steady")
    bin_ = F.floor(F.log2(F.greatest(squared_distance(), F.lit(_LEAST_DISTANCE))) * _BINS_PER_OCTAVE).cast("int").alias("bin")
    names = ["w", *(f"s{i}" for i in range(P)), *(f"p{i}{j}" for i, j in _PAIRS)]
    terms = [w, *(w * v[i] for i in range(P)), *(w * v[i] * v[j] for i, j in _PAIRS)]
    binned = _join_groups(rows, fit.select("group", "start", "n_rows", "location", "precision")).groupBy("group", "start", "n_rows", bin_)
    binned = binned.agg(F.count("*").alias("n"), *[F.sum(t).alias(k) for t, k in zip(terms, names, strict=True)])
    before = F.sum("n").over(W.partitionBy("group", "start").orderBy("bin")) - F.col("n")
    share = F.least((CORE_SHARE * F.col("n_rows") - F.col("before")) / F.col("n"), F.lit(1.0))
    core = binned.withColumn("before", before).withColumn("share", share).filter("share > 0")
    sums = core.groupBy("group", "start").agg(F.sum(F.col("n") * F.col("share")).alias("n"), *[F.sum(F.col(k) * F.col("share")).alias(k) for k in names])
    sums = sums.select("group", "start", "n", "w", F.array(*names[1 : 1 + P]).alias("sums"), F.array(*names[1 + P :]).alias("products"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                location, scatter = estimate(r.n, r.w, np.array(r.sums), np.array(r.products), guard)
                log_det = float(np.linalg.slogdet(scatter)[1])
                if log_det > r.log_det:
                    location, scatter, log_det = np.array(r.location), np.array(r.scatter).reshape(P, P), r.log_det
                out.append(_fit_row(r.group, r.start, r.n_rows, location, scatter, log_det, bool(log_det > r.log_det - TOLERANCE)))
            yield _fits(out)

    return fit.drop("precision", "done").join(sums, ["group", "start"]).mapInPandas(run, _FIT)


def pooled(fits: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(location, scatter) of (rows, location, scatter) from all documents to the narrowest group, each pooled with the one before."""
    _, location, scatter = fits[0]
    for n, own, own_scatter in fits[1:]:
        a = n / (n + POOL_ROWS)
        location, scatter = a * own + (1 - a) * location, a * own_scatter + (1 - a) * scatter
    return location, scatter


def fit_outliers(stats: DataFrame) -> DataFrame:
    """``group, location, precision`` for each language and source of a written table ``lang, source, vector, n_words, n_repeat_words``."""
    scratch = Scratch(stats.sparkSession, "mcd")
    good = stats.filter(~base_failed()).select(group_keys().alias("keys"), "vector", steadiness().alias("steady"))
    rows = scratch.save(good.distinct(), "rows")
    spread = rows.agg(F.array(*[F.coalesce(F.var_pop(F.col("vector")[i]), F.lit(0.0)) for i in range(P)])).first()[0]
    guard = GUARD * np.maximum(np.array(spread), 1e-6)
    groups = rows.select(F.explode("keys").alias("group"), "vector", "steady")
    fit = _starts(groups, guard, scratch)
    for k in range(FIRST_STEPS):
        fit = scratch.save(_c_step(groups, fit, guard), f"first-{k}")
    columns = [F.col(c) for c in fit.columns if c not in ("group", "start")]
    best = fit.groupBy("group").agg(F.min_by(F.struct("start", *columns), F.struct("log_det", "start")).alias("f")).select("group", "f.*")
    fits, active, k = [], scratch.save(best.withColumn("done", F.lit(False)), "best"), 0
    while not active.isEmpty():
        step = scratch.save(_c_step(groups, active, guard), f"step-{k}")
        fits.append(step.filter("done"))
        active, k = step.filter("not done"), k + 1
    done = fits[0] if fits else active
    for f in fits[1:]:
        done = done.unionAll(f)
    done = done.select("group", "n_rows", "location", "scatter")
    at = lambda level: done.filter(F.col("group").startswith(str(level))).select(*[F.col(c).alias(f"{c}{level}") for c in done.columns])
    keys = rows.select(F.col("keys")[0].alias("group2"), F.col("keys")[1].alias("group1"), F.col("keys")[2].alias("group0")).distinct()
    joined = keys.join(at(0), "group0").join(at(1), "group1").join(at(2), "group2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                levels = [(r[f"n_rows{k}"], np.array(r[f"location{k}"]), np.array(r[f"scatter{k}"]).reshape(P, P)) for k in range(3)]
                location, scatter = pooled(levels)
                out.append((r["group2"], location.tolist(), np.linalg.inv(scatter).ravel().tolist()))
            yield pd.DataFrame(out, columns=["group", "location", "precision"])

    result = scratch.save(joined.mapInPandas(run, "group string, location array<double>, precision array<double>"), "fit")
    scratch.drop("rows", "medians", "starts", "best", *(f"first-{i}" for i in range(FIRST_STEPS)), *(f"step-{i}" for i in range(k)))
    return result


def judge(stats: DataFrame, fit: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Adds ``base_failed``, ``distance`` (squared; null where no document of the group passes the base rules) and ``kept``."""
    df = _join_groups(stats.withColumn("group", group_keys()[0]), fit, "left").withColumn("steady", steadiness())
    df = df.withColumn("distance", squared_distance()).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return df.withColumn("kept", kept).drop("group", "steady", "location", "precision")


def quality_digest(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every document."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(with_stats(docs.select("doc_id", "lang", "source", "text"), styles), "stats")
    return judge(stats, fit_outliers(stats)).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``. Only statistics are written, and made once more beside the
    documents, so that no copy of these is left."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(with_stats(docs.select("lang", "source", "text"), styles), "stats")
    fit = fit_outliers(stats)
    scratch.drop("stats")
    rows = docs.select(F.struct("*").alias("row"), "lang", "source", "text")
    return judge(with_stats(rows, styles), fit).filter("kept").select("row.*")
