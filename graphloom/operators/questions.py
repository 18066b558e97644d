"""Question, candidate and split generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.paths import bfs, pair_distances
from graphloom.operators.sample import hash_key, sample_rows
from graphloom.plans import dense_index, sum_before

# Defaults of the question sets.
SEED = 2026
N_CANDIDATES = 10
TRAIN_HOPS, TEST_HOPS, VALIDATION_FRACTION, PER_HOP, MAX_GRAPHS = (1, 2), (3, 4), 0.2, 32, 16
QUESTION_TYPE = "RelationPrediction"
STATION_TYPE = "StationShortestCount"


def candidates(questions: DataFrame, vocab: DataFrame, n: int, seed: int, scope: str = "cand") -> DataFrame:
    """Adds ``candidates``: the answer and ``n - 1`` other relations (or all there are), in hash order.

    The vocabulary has a row for each relation; it becomes one array, so that a question's choice needs neither a
    cross join nor a shuffle of questions.
    """
    if n < 2:
        raise ValueError("at least two candidates are needed")
    words = vocab.agg(F.array_sort(F.collect_set("rel")).alias("_vocab"))
    key = lambda scope_, r: hash_key(seed, scope_, F.col("question_id"), r)
    others = F.filter("_vocab", lambda r: r != F.col("answer"))
    ranked = lambda scope_, a: F.transform(F.array_sort(F.transform(a, lambda r: F.struct(key(scope_, r).alias("k"), r.alias("r")))), lambda x: x["r"])
    chosen = F.concat(F.slice(ranked(scope, others), 1, n - 1), F.array("answer"))
    # one row
    return questions.crossJoin(F.broadcast(words)).withColumn("candidates", ranked(scope + "-order", chosen)).drop("_vocab")


def require_known_answers(questions: DataFrame, vocab: DataFrame) -> None:
    """Raises if an answer is no relation of the vocabulary."""
    missing = questions.select("answer").distinct().join(vocab.select(F.col("rel").alias("answer")), "answer", "left_anti").limit(5).collect()
    if missing:
        raise ValueError("answers outside of the vocabulary: " + ", ".join(sorted(str(r.answer) for r in missing)))


def relation_questions(triples: DataFrame, graph: DataFrame, vocab: DataFrame, split: str, limit: int, n: int = N_CANDIDATES, seed: int = SEED, name: str = "kg", max_depth: int | None = None) -> DataFrame:
    """Question rows of a split: sampled triples with candidates, distance and path in the undirected ``graph``
    (``node, next``, both ways)."""
    return with_paths(asked_relations(triples, vocab, split, limit, n, seed, name), graph, max_depth)


def asked_relations(triples: DataFrame, vocab: DataFrame, split: str, limit: int, n: int = N_CANDIDATES, seed: int = SEED, name: str = "kg") -> DataFrame:
    """Sampled triples of a split with candidates, for ``with_paths``, which searches those of all splits together."""
    rows = sample_rows(triples, seed, split, ["idx"], limit)
    rows = rows.select(
        F.concat_ws(":", F.lit(name), F.lit(split), F.col("idx").cast("string")).alias("question_id"), F.col("rel").alias("answer"),
        F.lit(split).alias("split"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("idx").alias("source_triple_index"),
    )
    return candidates(rows, vocab, n, seed)


def with_paths(asked: DataFrame, graph: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Question rows of ``asked_relations`` with their distances and paths."""
    rows = pair_distances(graph, asked, max_depth, symmetric=True)
    return rows.select(
        "question_id", X.relation_question(F.col("source"), F.col("target"), F.col("candidates")).alias("question"), "answer", "split",
        "true_hop", F.lit(QUESTION_TYPE).alias("question_type"), F.col("source").alias("source_node"), F.col("target").alias("target_node"),
        F.coalesce("path", F.array().cast("array<string>")).alias("shortest_path"), F.col("distance").alias("structural_distance"),
        F.col("reachable").alias("structural_reachable"), F.col("candidates").alias("candidate_relations"), "source_triple_index",
    )


def station_questions(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``source_node, target_node`` and ``reason`` (null if valid) to ``graph_id, question_id, question, question_type``.

    A name must fit exactly one node of the graph: ``graph_id, node_id, text``, and the two nodes must differ.
    """
    names = nodes.groupBy("graph_id", X.canonical_node_name(F.col("text")).alias("name")).agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"))
    # an absent or empty type is inferred from the question
    kind = F.nullif(F.col("question_type"), F.lit(""))
    out = questions.withColumn("is_station", F.coalesce(kind == STATION_TYPE, F.lit(False)) | (kind.isNull() & F.coalesce(F.col("question").rlike(X.STATIONS), F.lit(False))))
    for k, end in ((1, "source"), (2, "target")):
        side = names.select("graph_id", F.col("name").alias(f"{end}_name"), F.col("n").alias(f"{end}_n"), F.col("node_id").alias(f"{end}_node"))
        out = out.withColumn(f"{end}_name", F.regexp_replace(X.station_endpoint(F.col("question"), k), r"^\s+|\s+$", "")).join(side, ["graph_id", f"{end}_name"], "left")
    unique = (F.col("source_n") == 1) & (F.col("target_n") == 1)
    reason = (
        F.when(~F.col("is_station"), "rejected_question_type")
        .when(F.col("source_name").isNull(), f"rejected_question_does_not_match_{STATION_TYPE}")
        .when(~F.coalesce(unique, F.lit(False)), "rejected_endpoint_extraction_ambiguous")
        .when(F.col("source_node") == F.col("target_node"), "rejected_source_and_target_must_be_distinct")
    )
    return out.withColumn("reason", reason).drop("source_n", "target_n", "is_station")


def path_questions(questions: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Station questions with ``true_hop, shortest_path, frontiers, reason``. The label must be max(hop - 1, 0).
    ``frontiers`` has the sorted nodes at each distance from 0 to the hop from the source.

    Graph and node together are the search's node, so that all graphs are searched at once.
    """
    q = station_questions(questions, nodes)
    at = lambda g, n: F.concat_ws(" ", F.col(g).cast("string"), F.lpad(F.col(n).cast("string"), 12, "0"))
    ends = edges.filter(F.col("src") != F.col("dst"))
    neighbours = ends.select(F.explode(F.array(F.struct(at("graph_id", "src").alias("node"), at("graph_id", "dst").alias("next")), F.struct(at("graph_id", "dst").alias("node"), at("graph_id", "src").alias("next")))).alias("w")).select("w.*").distinct()
    q = q.withColumns({"source": F.when(F.col("reason").isNull(), at("graph_id", "source_node")), "target": F.when(F.col("reason").isNull(), at("graph_id", "target_node"))})
    found = bfs(neighbours, q.filter("source is not null").select("source").distinct(), max_depth, paths=True, symmetric=True)
    number = lambda c: F.substring_index(c, " ", -1).cast("long")
    levels = found.groupBy("source", "distance").agg(F.array_sort(F.collect_list(number("node"))).alias("nodes"))
    levels = levels.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "nodes"))), lambda x: x["nodes"]).alias("frontiers"))
    q = q.join(found.withColumnRenamed("node", "target"), ["source", "target"], "left").withColumnRenamed("distance", "true_hop").join(levels, "source", "left")
    label = X.integer_label(F.col("answer"))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("true_hop").isNull(), "rejected_endpoints_are_disconnected")
        .when(label.isNull(), "rejected_answer_is_not_an_integer")
        .when(label != F.greatest(F.col("true_hop") - 1, F.lit(0)), "rejected_label/path_mismatch")
    )
    q = q.withColumn("reason", reason)
    valid = lambda c: F.when(F.col("reason").isNull(), c)
    fronts = F.slice("frontiers", F.lit(1), F.coalesce("true_hop", F.lit(0)) + 1)
    return q.withColumns({"shortest_path": valid(F.transform("path", number)), "frontiers": valid(fronts)}).drop("path", "source", "target", "source_name", "target_name")


def hop_split(
    questions: DataFrame, train_hops=TRAIN_HOPS, validation_hops=TRAIN_HOPS, test_hops=TEST_HOPS,
    fraction: float = VALIDATION_FRACTION, cap: int | None = PER_HOP, seed: int = SEED,
) -> DataFrame:
    """``split`` for valid questions ``graph_id, question_id, true_hop``: per graph and hop in hash order, up to ``cap``;
    test hops go to test, of the others the first go to validation and the rest to train. Other hops are left out, see
    ``outside_hops``."""
    if set(train_hops) & set(test_hops):
        raise ValueError("train and test hops must be disjoint")
    hop = F.col("true_hop")
    w = W.partitionBy("graph_id", "true_hop")
    place = F.row_number().over(w.orderBy(hash_key(seed, "hop", F.col("graph_id"), F.col("question_id")), "question_id"))
    rows = questions.filter(hop.isin(*train_hops, *validation_hops, *test_hops)).withColumn("_place", place)
    if cap:
        rows = rows.filter(F.col("_place") <= cap)
    rows = rows.withColumn("_n", F.count("*").over(w))
    held = F.when(F.col("_n") > 1, F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("long")))).otherwise(0)
    held = F.when(hop.isin(*validation_hops) & F.lit(fraction > 0), held).otherwise(0)
    split = F.when(hop.isin(*test_hops), "test").when(F.col("_place") <= held, "validation").when(hop.isin(*train_hops), "train")
    return rows.withColumn("split", split).filter("split is not null").drop("_place", "_n")


def outside_hops(questions: DataFrame, train_hops=TRAIN_HOPS, validation_hops=TRAIN_HOPS, test_hops=TEST_HOPS) -> DataFrame:
    """Valid questions whose hop is in no split, with their ``reason``."""
    inside = F.coalesce(F.col("true_hop").isin(*train_hops, *validation_hops, *test_hops), F.lit(False))
    return questions.filter(~inside).withColumn("reason", F.lit("rejected_hop_outside_requested_range"))


def split_statistics(accepted: DataFrame, rejected: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``name, n``: 'accepted_{split}_hop_{h}' and rejections by reason. A hop of training questions has a count of both
    train and validation, if only 0."""
    hop = F.col("true_hop").cast("string")
    counted = lambda s: F.struct(F.concat(F.lit(f"accepted_{s}_hop_"), hop).alias("name"), (F.col("split") == s).cast("long").alias("n"))
    names = F.when(F.col("split") == "test", F.array(counted("test"))).otherwise(F.array(counted("validation"), counted("train")))
    by = by or []
    rows = accepted.select(*by, F.explode(names).alias("s")).select(*by, "s.name", "s.n")
    rows = rows.unionAll(rejected.select(*by, F.col("reason").alias("name"), F.lit(1).cast("long").alias("n")))
    return rows.groupBy(*by, "name").agg(F.sum("n").alias("n"))


def _with_place(split: DataFrame, graphs: DataFrame, order: list[str]) -> DataFrame:
    """``graph_id, ok, place, before``: whether a graph has both train and test questions, its place, and how many such
    graphs come before it."""
    has = lambda s: F.coalesce(F.bool_or(F.col("split") == s), F.lit(False))
    ok = graphs.join(split, "graph_id", "left").groupBy("graph_id", *[c for c in order if c != "graph_id"]).agg((has("train") & has("test")).alias("ok"))
    rows = dense_index(ok, "place", [*order, *([] if "graph_id" in order else ["graph_id"])])
    return sum_before(rows.withColumn("_ok", F.col("ok").cast("long")), "_ok", "before", ["place"]).drop("_ok")


def graphs_with_both(split: DataFrame, order: str = "graph_id", max_graphs: int = MAX_GRAPHS) -> DataFrame:
    """Rows of the first ``max_graphs`` graphs (all if it is 0) that have both train and test questions. ``order`` is a
    column of the graphs, such as their place in the input."""
    has = lambda s: F.bool_or(F.col("split") == s)
    first = [] if order == "graph_id" else [F.min(order).alias(order)]
    good = split.groupBy("graph_id").agg((has("train") & has("test")).alias("ok"), *first).filter("ok").orderBy(order, "graph_id")
    good = good.limit(max_graphs) if max_graphs > 0 else good
    return split.join(good.select("graph_id"), "graph_id", "left_semi")


def dataset_statistics(graphs: DataFrame, accepted: DataFrame, rejected: DataFrame, order: str = "graph_id", max_graphs: int = MAX_GRAPHS) -> DataFrame:
    """``name, n`` over the graphs that are taken in order until there are ``max_graphs`` (0: all): the statistics of
    those with both train and test questions, their number, and the number of graphs passed over."""
    places = _with_place(accepted.select("graph_id", "split"), graphs.select("graph_id", *([] if order == "graph_id" else [order])), [order])
    seen = places.filter(F.col("before") < max_graphs) if max_graphs > 0 else places
    kept = seen.filter("ok").select("graph_id")
    of = lambda df: df.join(kept, "graph_id", "left_semi")
    named = F.when(F.col("ok"), "accepted_graphs").otherwise("rejected_graph_missing_train_or_test")
    return split_statistics(of(accepted), of(rejected)).unionAll(seen.groupBy(named.alias("name")).agg(F.count("*").alias("n")))


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Parts with their name as ``split``."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def route_split(rows: DataFrame, key: str, train: DataFrame, validation: DataFrame) -> DataFrame:
    """``split`` by membership of ``key``: train, else val, else test."""
    for name, ids in (("train", train), ("val", validation)):
        rows = rows.join(ids.select(key).distinct().withColumn(f"_{name}", F.lit(name)), key, "left")
    return rows.withColumn("split", F.coalesce("_train", "_val", F.lit("test"))).drop("_train", "_val")


def regroup(rows: DataFrame, values: list[str | Column], order: str) -> DataFrame:
    """Parallel arrays by graph in row order, with each graph's offset in order of first sight."""
    lists = F.array_sort(F.collect_list(F.struct(order, *values)))
    groups = rows.groupBy("graph_id").agg(F.min(order).alias("first"), F.count("*").alias("n"), lists.alias("rows"))
    return sum_before(groups, "n", "offset", ["first", "graph_id"])
