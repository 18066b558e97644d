import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import preference, registry
from graphloom.sources import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = registry.op3_quality_classifier(spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.98
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.99


def test_edge_cases(spark, make_docs):
    docs = make_docs([None, "", "a b c", "# # #" * 50], ids=[1, 2, None, 4]).withColumns({"x": F.lit(1), "y": F.lit(2), "id": F.lit(3), "vector": F.lit("v")})
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = preference.quality_scores(docs, labels).collect()
    assert len(rows) == 4 and all(r.score is not None for r in rows)
    none = preference.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert preference.quality_scores(docs.limit(0), labels).count() == 0


def test_the_fit_against_brute_force():
    """Gradient descent on every pair, written out."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = (x @ [1.0, 0.3, -4] + rng.normal(size=60) > np.median(x @ [1.0, 0.3, -4])).astype(int)
    weights, offset, slope = preference.fit(x, y)
    scale = x.std(0) + 1e-6
    pairs = np.array([(a - b) / scale for a in x[y == 1] for b in x[y == 0]])
    w = np.zeros(3)
    for _ in range(20_000):
        w -= 0.5 * (-(pairs / (1 + np.exp(pairs @ w))[:, None]).mean(0) + preference.RIDGE * w)
    assert np.allclose(weights * scale, w, rtol=1e-4) and slope > 0
    above = (x @ weights > offset).sum()
    assert above == (y == 1).sum()


def test_repeated_rows_long_texts_and_ties(spark, make_docs):
    good, bad = " ".join(f"word{i} and so on." for i in range(90)), "### $$$ " * 90
    docs = make_docs([good, bad] * 20 + [good * 2000] + [good] * 5, ids=[*range(40), 99, *[0] * 5])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    rows = preference.quality_scores(docs, labels).collect()
    assert len(rows) == 46
    scores = {}
    for r in rows:
        scores.setdefault(r.doc_id % 2 if r.doc_id < 99 else 2, set()).add(r.score)
    assert len(scores[0]) == len(scores[1]) == 1 and min(scores[0]) >= 0.7 > max(scores[1])
