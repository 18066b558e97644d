"""Quality classifier by Bradley-Terry pairwise ranking.

A document's utility is linear in the transformed statistics of its whole text.
Preference pairs join a good and a bad labelled document; the probability that
the good one wins is the logistic function of the difference of utilities, so
the weights minimise logistic loss on the feature differences of all pairs of the
labelled rows (Newton steps with a ridge; sums over pairs are matrix products by
blocks, no pair is written). The utility at the quantile that parts the labelled classes becomes the
threshold: utilities are mapped to scores so that it scores ``THRESHOLD``.

The labelled rows of the fit are bounded: the ``MAX_LABELLED`` labels of least
hash, with a single row each, that of the least features where several documents
have the id. Everything else runs over all documents in one stage without a
shuffle but the join of labels. Labels, language, source and id are no inputs of
a score. Null and empty texts score like any other, texts of any length are read
whole, equal texts get equal scores; with no labelled pair every score is 0.5. An
empty table gives an empty result. Different labels of a document all count, and
so may equal scores of both classes. Extra columns aren't read, whatever their
names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textstats import SHAPES, with_stats
from graphloom.plans import Scratch

THRESHOLD = 0.7
MAX_LABELLED = 8_000
_BLOCK = 256
FOLDS, HELD_OUT = 4, 2
RIDGE = 1e-3
NEWTON_STEPS = 30
#: ``SHAPES``, log of the number of words, and squares of the shares.
N_FEATURES = 2 * len(SHAPES)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features(vector: Column, n_words: Column) -> Column:
    v = [vector[i] for i in range(len(SHAPES))]
    return F.array(*v, F.log1p(n_words.cast("double")), *[x * x for x in v[1:]])


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, summed over the differences of every good and bad row."""
    p = good.shape[1]
    gradient, hessian, u = np.zeros(p), np.zeros((p, p)), bad @ w
    for at in range(0, len(good), _BLOCK):
        some = good[at : at + _BLOCK]
        wins = 1 / (1 + np.exp(-np.clip((some @ w)[:, None] - u, -30, 30)))
        miss, spread = 1 - wins, wins * (1 - wins)
        gradient -= some.T @ miss.sum(1) - bad.T @ miss.sum(0)
        cross = some.T @ spread @ bad
        hessian += (some * spread.sum(1)[:, None]).T @ some + (bad * spread.sum(0)[:, None]).T @ bad - cross - cross.T
    return gradient, hessian


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, offset, slope): scores are logistic(slope * (x @ weights - offset) + logit(THRESHOLD))."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), 0.0, 0.0
    scale = x.std(0) + 1e-6
    g, b = good / scale, bad / scale
    w = np.zeros(x.shape[1])
    for _ in range(NEWTON_STEPS):
        gradient, hessian = pair_sums(g, b, w)
        n = len(g) * len(b)
        step = np.linalg.solve(hessian / n + RIDGE * np.eye(len(w)), gradient / n + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    utility = x @ w
    # the quantile that leaves as many above as there are good documents, amid its neighbours
    order = np.sort(utility)
    offset = float((order[len(bad) - 1] + order[len(bad)]) / 2)
    spread = float(np.median(good @ w) - np.median(bad @ w))
    return w, offset, 8 / spread if spread > 0 else 0.0


def score(x: Column, model: tuple[np.ndarray, float, float]) -> Column:
    weights, offset, slope = model
    utility = F.lit(0.0)
    for k, w in enumerate(weights.tolist()):
        utility = utility + x[k] * w
    shift = math.log(THRESHOLD / (1 - THRESHOLD)) if slope else 0.0
    z = F.greatest(F.least((utility - offset) * slope + shift, F.lit(500.0)), F.lit(-500.0))
    return 1 / (1 + F.exp(-z))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scratch = Scratch(docs.sparkSession, "preference")
    stats = with_stats(docs.select("doc_id", "text")).select("doc_id", features(F.col("vector"), F.col("n_words")).alias("x"))
    stats = scratch.save(stats, "features")
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("id")) & F.col("id").isNotNull())
    # the bound of the fit: least hashes of all labelled rows
    known = known.distinct().orderBy(F.xxhash64("id"), "id", "y").limit(MAX_LABELLED)
    # a row for each label
    rows = stats.join(known, F.col("doc_id") == F.col("id")).groupBy("id", "y").agg(F.min("x").alias("x")).orderBy("id", "y").select("x", "y").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, N_FEATURES)
    model = fit(x, np.array(rows.column("y").to_pylist(), int))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
