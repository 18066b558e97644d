import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, registry

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.01"


def targets_by_rounds(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(3 * sizes[s]) for s in over}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 3, None: 50}, {"a": 0, "b": 5}, {"x": 7}, {"a": 1, "b": 1, "c": 10_000, "d": 2}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert found == pytest.approx(targets_by_rounds(sizes))


def test_budgets_are_exact(spark, make_docs):
    texts = ["w " * (n % 17) for n in range(200)] + [None, "", " one\ttwo x "] * 3
    docs = make_docs(texts, sources=("s1", "s2", None, "s3"))
    digest = mixing.mix_digest(docs)
    rows = digest.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()
    assert all(0 <= r.target - r.taken < 1 + 1e-6 for r in rows)
    assert sum(r.target for r in rows) == pytest.approx(sum(r["size"] for r in rows))
    assert digest.filter("taken > 3 * size").isEmpty()
    words = mixing.mix_documents(docs).select("doc_id", mixing.word_count(F.col("text")).alias("w")).groupBy("doc_id").agg(F.sum("w").alias("w"))
    joined = digest.join(words, "doc_id", "left").filter("taken > 0 and not taken <=> w")
    assert joined.isEmpty()
    assert {tuple(r) for r in digest.collect()} == {tuple(r) for r in mixing.mix_digest(docs.repartition(7)).collect()}


def test_repeated_rows_empty_table_and_extra_columns(spark, make_docs):
    docs = make_docs(["a b c"] * 10, sources=("x",), ids=[1] * 10).withColumns({"size": F.lit(1), "key": F.lit("k"), "epochs": F.lit(9), "last": F.lit(0)})
    assert mixing.mix_digest(docs).agg(F.sum("taken")).first()[0] == 30
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_digest(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_against_oracle(spark):
    assert_same(registry.op1_mix_sources(spark, SF), registry.ORACLE_SQL["op1_mix_sources"], connect(SF))
