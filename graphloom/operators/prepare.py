"""One call from triples to graph tables, questions of three splits and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import paths as P
from graphloom.operators import questions as Q
from graphloom.plans import Scratch
from graphloom.sources import sinks

#: Questions of the three splits.
LIMITS = {"train": 64, "validation": 32, "test": 64}


def prepare_questions(
    train: DataFrame, validation: DataFrame, test: DataFrame, dictionary: DataFrame, name: str,
    limits: dict[str, int] = LIMITS, n_candidates: int = Q.N_CANDIDATES, seed: int = Q.SEED, max_depth: int | None = None,
) -> dict[str, DataFrame]:
    """``nodes``, ``edges``, ``questions`` and ``stats`` of triples ``idx, src, rel, dst`` and a dictionary ``entity``.

    The training triples are the graph and its vocabulary; a relation of the other triples that it lacks is an error.
    ``stats``: ``split, available, selected, distance_counts`` (map of distance or 'unreachable').
    """
    if n_candidates < 2:
        raise ValueError("at least two candidates are needed")
    splits = {"train": train, "validation": validation, "test": test}
    G.require_known_relations(train, validation.unionByName(test))
    scratch = Scratch(train.sparkSession, "prepare")
    shifted = [t.withColumn("idx", F.col("idx") + F.lit(k << 40)) for k, t in enumerate(splits.values())]
    nodes = scratch.save(G.node_ids(dictionary, shifted[0].unionByName(shifted[1]).unionByName(shifted[2])), "nodes")
    vocab = scratch.save(G.relation_vocab(train), "vocab")
    # the splits' pairs are searched together: a search's passes over the graph and its rounds are made once
    asked = [Q.asked_relations(triples, vocab, split, limits[split], n_candidates, seed, name) for split, triples in splits.items()]
    asked = scratch.save(asked[0].unionByName(asked[1]).unionByName(asked[2]), "asked")
    questions = scratch.save(Q.with_paths(asked, P.adjacency(train), max_depth), "questions")
    by = F.coalesce(F.col("structural_distance").cast("string"), F.lit("unreachable"))
    stats = None
    for split, triples in splits.items():
        rows = questions.filter(F.col("split") == split)
        counts = rows.groupBy(by.alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("distance_counts"))
        row = triples.agg(F.lit(split).alias("split"), F.count("*").alias("available")).join(rows.agg(F.count("*").alias("selected"))).join(counts)
        stats = row if stats is None else stats.unionByName(row)
    # three rows, kept in order
    stats = scratch.save(stats.coalesce(1), "stats")
    return {"nodes": nodes, "edges": G.materialize_edges(train, nodes), "questions": questions, "stats": stats}


def graph_statistics(prepared: dict[str, DataFrame]) -> DataFrame:
    """One row: ``nodes, edges, relations``."""
    edges = prepared["edges"].agg(F.count("*").alias("edges"), F.count_distinct("rel").alias("relations"))
    return prepared["nodes"].agg(F.count("*").alias("nodes")).join(edges)


def write_prepared(prepared: dict[str, DataFrame], path: str, name: str, seed: int = Q.SEED) -> None:
    """Writes nodes, edges and questions as JSON lines below ``path`` and their statistics beside it."""
    for part in ("nodes", "edges", "questions"):
        sinks.write_records(prepared[part], f"{path}/{part}")
    splits = F.map_from_entries(F.collect_list(F.struct("split", F.struct("available", "selected", "distance_counts"))))
    stats = prepared["stats"].agg(splits.alias("splits")).join(graph_statistics(prepared).select(F.struct("*").alias("graph")))
    sinks.write_stats(stats.select(F.lit(name).alias("dataset"), "graph", "splits", F.lit(seed).alias("seed")), path)
