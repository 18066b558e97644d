import hashlib
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import paths as P
from graphloom.operators import questions as Q
from graphloom.operators import sample as S
from graphloom.operators import tasks as T
from graphloom.operators.prepare import prepare_questions
from graphloom.plans import Scratch, dense_index_by

EDGES = "graph_id long, edge_id long, src string, rel string, dst string"


def edges(spark, rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], EDGES)


def test_clean_keeps_the_first_edge_with_its_label_and_compat_shifts_labels(spark):
    e = edges(spark, [("0", "r1", "1"), ("1", "loop", "1"), ("0", "r2", "1"), ("1", "r3", "2")])
    assert {(r.edge_id, r.rel) for r in G.clean_edges(e).collect()} == {(0, "r1"), (3, "r3")}
    assert {(r.edge_id, r.rel) for r in G.clean_edges_compat(e).collect()} == {(0, "r1"), (3, "loop")}
    w = {r.node: r.weight for r in G.node_weights(G.clean_edges(e)).collect()}
    assert w == {"0": 0.5, "1": 0.5, "2": 0.5}
    assert [r.weight for r in G.edge_weights(G.clean_edges(e)).collect()] == [1.0, 1.0]


def test_isolated_nodes_weigh_a_half(spark):
    nodes = spark.createDataFrame([(0, "a"), (0, "z")], "graph_id long, node string")
    w = {r.node: r.weight for r in G.node_weights(edges(spark, [("a", "r", "b")]), nodes).collect()}
    assert w == {"a": 0.5, "z": 0.5}


def test_weights_of_nodes_and_edges_meet_in_one_table(spark):
    # b and c are both sources and targets, d is a target only; graph 1 shares names with graph 0
    rows = [("a", "r", "b"), ("a", "s", "c"), ("b", "r", "c"), ("c", "r", "b"), ("c", "r", "d"), ("b", "x", "c"), ("d", "r", "d")]
    e = edges(spark, rows).unionAll(spark.createDataFrame([(1, 0, "a", "r", "b"), (None, 0, "a", "r", "b")], EDGES))
    clean = G.clean_edges(e, by_source=True)
    assert sorted(map(str, clean.collect())) == sorted(map(str, G.clean_edges(e).collect()))
    nodes, kept = G.weights(clean)
    weights = lambda df, *keys: sorted(map(str, df.select("graph_id", *keys, "weight").collect()))
    assert weights(nodes, "node") == weights(G.node_weights(clean), "node")
    names = ("edge_id", "src", "rel", "dst")
    assert weights(kept, *names) == weights(G.edge_weights(clean), *names)
    w = {(r.src, r.dst): r.weight for r in kept.filter("graph_id = 0").collect()}
    assert w == {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "c"): 1 / 2**0.5, ("c", "b"): 0.5, ("c", "d"): 1 / 2**0.5}
    assert {r.weight for r in kept.filter("graph_id IS NULL").collect()} == {1.0}


def test_counts_and_spans_move_no_weights(spark):
    e = spark.range(20000).select((F.col("id") % 7).alias("graph_id"), F.col("id").alias("edge_id"), F.col("id").cast("string").alias("src"), F.lit("r").alias("rel"), (F.col("id") % 100).cast("string").alias("dst"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # a shuffle to the source and one to the target
    assert plan(G.edge_weights(e)).count("Exchange") == 2 and "Join" not in plan(G.edge_weights(e))
    w = Scratch(spark, "test").save(G.node_weights(e), "weights")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        assert "SortMergeJoin" not in plan(G.upsample_counts(w, ["graph_id"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_prompts_are_made_in_as_many_tasks_as_there_are_shuffle_partitions(spark):
    e = spark.range(400).select((F.col("id") % 40).alias("graph_id"), F.col("id").alias("edge_id"), F.col("id").cast("string").alias("src"), F.lit("r").alias("rel"), F.lit("x").alias("dst"))
    q = spark.range(800).select((F.col("id") % 41).alias("graph_id"), F.col("id").alias("question_id"), F.lit("Where?").alias("question"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = T.graph_prompts(q, e).select("question_id", F.length("prompt").alias("n"), F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == 800 and len({r.p for r in rows}) == 4
    # graph 40 has no edges
    assert {r.question_id % 41 for r in rows if r.n == min(x.n for x in rows)} == {40}


def test_chain_questions(spark):
    chain = [("a", "r1", "b"), ("b", "r2", "c"), ("c", "r3", "d"), ("d", "r1", "e"), ("e", "r2", "f"), ("f", "r3", "g")]
    graph = P.adjacency(edges(spark, chain))
    triples = spark.createDataFrame([(0, "a", "r3", "c"), (1, "a", "r2", "g"), (2, "a", "r2", "missing"), (3, "z", "r1", "z")], "idx long, src string, rel string, dst string")
    vocab = G.relation_vocab(edges(spark, chain))
    rows = {r.source_triple_index: r for r in Q.relation_questions(triples, graph, vocab, "validation", 0, 3).collect()}
    assert rows[0].true_hop == 2 and rows[0].shortest_path == ["a", "b", "c"] and rows[0].question_id == "kg:validation:0"
    assert rows[1].true_hop == 6
    assert rows[2].true_hop is None and not rows[2].structural_reachable
    assert rows[3].structural_distance == 0 and rows[3].true_hop is None and rows[3].structural_reachable
    assert all(sorted(r.candidate_relations) == ["r1", "r2", "r3"] and r.answer in r.candidate_relations for r in rows.values())


def test_path_graph(spark):
    nodes = spark.createDataFrame([(0, i, f"{n} {'has' if i % 2 == 0 else 'does not have'} disabled access") for i, n in enumerate("ABCDEF")], "graph_id long, node_id long, text string")
    e = spark.createDataFrame([(0, a, b) for a, b in [(0, 1), (1, 2), (2, 3), (0, 4), (4, 5)]], "graph_id long, src long, dst long")
    ask = lambda i, a, b, answer: (0, i, f"How many stations are between {a} and {b}?", answer, None)
    q = spark.createDataFrame([ask("x", "A", "D", "2"), ask("y", "A", "F", "2"), ask("z", "A", "F", "one"), ask("w", "A", "A", "0")], "graph_id long, question_id string, question string, answer string, question_type string")
    r = {x.question_id: x for x in Q.path_questions(q, nodes, e).collect()}
    assert r["x"].true_hop == 3 and r["x"].shortest_path == [0, 1, 2, 3] and r["x"].reason is None
    assert r["y"].true_hop == 2 and r["y"].reason == "rejected_label/path_mismatch"
    assert r["z"].reason == "rejected_answer_is_not_an_integer"
    assert r["x"].frontiers == [[0], [1, 4], [2, 5], [3]] and r["y"].frontiers is None
    assert r["w"].reason == "rejected_source_and_target_must_be_distinct"


def test_line_graph_hop_split(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (2, 4), (0, 3), (1, 4), (0, 4)]
    q = spark.createDataFrame([(0, f"{a}-{b}", b - a) for a, b in pairs], "graph_id long, question_id string, true_hop int")
    rows = Q.hop_split(q, fraction=0.5, cap=None, seed=11).collect()
    by = {s: sorted(r.true_hop for r in rows if r.split == s) for s in ("train", "validation", "test")}
    assert by == {"train": [1, 2], "validation": [1, 2], "test": [3, 3, 4]}
    again = Q.hop_split(q.repartition(3), fraction=0.5, cap=None, seed=11).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}


def test_hop_split_without_validation_and_outside_of_the_range(spark):
    q = spark.createDataFrame([(0, f"{k}", 1 + k % 6) for k in range(60)], "graph_id long, question_id string, true_hop int")
    split = Q.hop_split(q, fraction=0)
    assert {r.split for r in split.collect()} == {"train", "test"}
    counts = {r.name: r.n for r in Q.split_statistics(split, Q.outside_hops(q)).collect()}
    assert counts == {"accepted_train_hop_1": 10, "accepted_train_hop_2": 10, "accepted_validation_hop_1": 0, "accepted_validation_hop_2": 0, "accepted_test_hop_3": 10, "accepted_test_hop_4": 10, "rejected_hop_outside_requested_range": 20}


def test_directed_cycles_end(spark):
    e = edges(spark, [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d"), ("d", "r", "b")])
    sources = spark.createDataFrame([("a",), ("d",)], "source string")
    found = {(r.source, r.node): (r.distance, list(r.path)) for r in P.bfs(P.adjacency(e, directed=True), sources, paths=True).collect()}
    assert found == {
        ("a", "a"): (0, ["a"]), ("a", "b"): (1, ["a", "b"]), ("a", "c"): (2, ["a", "b", "c"]), ("a", "d"): (3, ["a", "b", "c", "d"]),
        ("d", "d"): (0, ["d"]), ("d", "b"): (1, ["d", "b"]), ("d", "c"): (2, ["d", "b", "c"]), ("d", "a"): (3, ["d", "b", "c", "a"]),
    }


def test_guards(spark):
    e = edges(spark, [("a", "r1", "b"), ("b", "r2", "c")])
    with pytest.raises(ValueError, match="r2"):
        G.require_known_relations(e.filter("rel = 'r1'"), e)
    with pytest.raises(ValueError, match="r2"):
        Q.require_known_answers(e.select(F.col("rel").alias("answer")), e.filter("rel = 'r1'").select("rel"))
    with pytest.raises(ValueError, match="3 rows"):
        S.sample_exactly(e, 1, "x", ["edge_id"], 3)
    with pytest.raises(ValueError, match="fewer than 3"):
        S.require_rows(e, ["graph_id"], 3)
    assert S.sample_exactly(e, 1, "x", ["edge_id"], 2).count() == 2


def test_an_exact_sample_is_drawn_once(spark):
    e = edges(spark, [(f"a{k}", "r", "b") for k in range(50)])
    rows = S.sample_exactly(e, 1, "x", ["edge_id"], 20)
    assert "TakeOrdered" not in rows._jdf.queryExecution().executedPlan().toString()
    first = sorted(e.collect(), key=lambda r: (hashlib.md5(f"1:x:{r.edge_id}".encode()).hexdigest(), r.edge_id))[:20]
    assert sorted(r.edge_id for r in rows.collect()) == sorted(r.edge_id for r in first)


def test_parallel_edges_and_frontiers(spark):
    e = edges(spark, [("A", "r", "B"), ("B", "r", "C"), ("C", "r", "D"), ("A", "r", "E"), ("E", "r", "F"), ("A", "q", "B")])
    sources = spark.createDataFrame([("A",)], "source string")
    levels = {r.depth: r.nodes for r in P.frontiers(P.bfs(P.adjacency(e), sources), 4).collect()}
    assert levels == {0: ["A"], 1: ["B", "E"], 2: ["C", "F"], 3: ["D"], 4: []}
    roots = spark.createDataFrame([("q", "A")], "query string, node string")
    assert sorted(r.edge_id for r in P.khop_subgraph(e, roots, hops=1).collect()) == [0, 3, 5]


def least_paths(pairs, source):
    adjacent = {}
    for a, b in pairs:
        if a != b:
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
    path, queue = {source: [source]}, deque([source])
    while queue:
        n = queue.popleft()
        for m in sorted(adjacent.get(n, ())):
            if m not in path:
                path[m] = path[n] + [m]
                queue.append(m)
    return path


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), min_size=1, max_size=12))
def test_paths_equal_a_sorted_breadth_first_search(spark, pairs):
    e = edges(spark, [(a, "r", b) for a, b in pairs])
    found = P.bfs(P.adjacency(e), spark.createDataFrame([("a",)], "source string"), paths=True).collect()
    assert {r.node: list(r.path) for r in found} == least_paths(pairs, "a")


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=12))
def test_paths_from_both_ends(spark, links):
    names = "abcdefghz"
    pairs = spark.createDataFrame([(a, b) for a in names for b in names] + [("a", "b"), (None, "a")], "source string, target string")
    found = {(r.source, r.target): (r.distance, list(r.path)) for r in P.pair_paths(P.adjacency(edges(spark, [(a, "r", b) for a, b in links])), pairs).collect()}
    want = {(a, b): (len(p) - 1, p) for a in names for b, p in least_paths(links, a).items()}
    assert found == want


def test_both_searches_agree(spark):
    graph = P.adjacency(edges(spark, [(a, "r", b) for a, b in ("ab", "bc", "cd", "ad", "de", "xy")]))
    pairs = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(("ae", "bd", "ax", "zz", "ya", "ca"))], "source string, target string, k int")
    rows = [sorted(map(tuple, P.pair_distances(graph, pairs, symmetric=True, both_ends=w).select("k", "distance", "path", "reachable", "true_hop").collect())) for w in (True, False, None)]
    assert rows[0] == rows[1] == rows[2] and [r[1] for r in rows[0]] == [2, 2, None, 0, None, 2]


def test_a_hub_beside_the_way_and_settled_pairs_are_not_extended(spark):
    """Near the source is a hub of 20,000 leaves; the way leads along a chain on the other side of it."""
    leaves = spark.range(20_000).select(F.lit("hub").alias("node"), F.concat(F.lit("leaf"), "id").alias("next"))
    chain = [f"c{k:03}" for k in range(13)]
    links = spark.createDataFrame([("s", "hub"), ("s", chain[0]), *zip(chain, chain[1:])], "node string, next string")
    one = leaves.unionAll(links)
    both = one.unionAll(one.select(F.col("next").alias("node"), F.col("node").alias("next")))
    pairs = spark.createDataFrame([("s", chain[-1]), ("leaf7", "s"), ("s", "nowhere"), (chain[3], chain[4])], "source string, target string")
    written = []
    found = {(r.source, r.target): list(r.path) for r in P.pair_paths(both, pairs, written=written).collect()}
    assert found == {("s", chain[-1]): ["s", *chain], ("leaf7", "s"): ["leaf7", "hub", "s"], (chain[3], chain[4]): [chain[3], chain[4]]}
    # the hub is never expanded, and after three rounds one pair is left with at most two levels of each side
    assert sum(written) < 100 and max(written[3:]) <= 6 and written[-1] == 0
    assert P.pair_paths(both, pairs, max_depth=2).count() == 2
    assert P.pair_paths(both, pairs.limit(0)).collect() == []


def test_leaves_of_hubs_on_the_way_are_not_extended(spark):
    """Two hubs of 500 leaves each that meet in a root, and pairs of hubs, of leaves and of a leaf and its own hub."""
    links = [(f"{h}{k}", h) for h in "ab" for k in range(500)] + [("a", "r"), ("b", "r"), ("r", "top"), ("x", "y")]
    both = spark.createDataFrame(links + [(v, u) for u, v in links], "node string, next string")
    ways = [["a", "r", "b"], ["a7", "a", "r", "b", "b9"], ["a3", "a"], ["b", "b4"], ["a1", "a", "a2"], ["top", "r", "a", "a5"], ["x", "y"]]
    pairs = spark.createDataFrame([(w[0], w[-1]) for w in ways] + [("x", "a"), ("a8", "y")], "source string, target string")
    written = []
    found = {(r.source, r.target): list(r.path) for r in P.pair_paths(both, pairs, written=written).collect()}
    assert found == {(w[0], w[-1]): w for w in ways}
    assert sum(written) < 100
    assert {r.target for r in P.pair_paths(both, pairs, max_depth=1).collect()} == {"a", "b4", "y"}


def test_numbers_within_groups(spark):
    rows = [(None if g == 2 else g, (7 * i) % 101, "x") for g in range(4) for i in range(101 if g else 3)]
    df = spark.createDataFrame(rows, "g long, v long, name string").repartition(7)
    got = dense_index_by(df, ["g"], "n", ["v"]).collect()
    assert len(got) == len(rows)
    for g in (0, 1, None, 3):
        mine = sorted((r.n, r.v) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_ends_are_dealt_before_they_are_counted(spark):
    edges = spark.createDataFrame([(0, 0, "a", "r", "b"), (0, 1, "b", "r", "c")], "graph_id long, edge_id long, src string, rel string, dst string")
    plan = G.degrees(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") < plan.index("hashpartitioning(graph_id")
    assert sorted(tuple(r) for r in G.degrees(edges).collect()) == [(0, "a", 0, 1), (0, "b", 1, 1), (0, "c", 1, 0)]


def test_the_order_of_a_shuffle_is_computed_before_the_sort(spark, monkeypatch):
    """As columns, not within the sort, where each comparison would hash both rows again."""
    plans, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, name, *a))
    edges = spark.createDataFrame([(g, e, f"a{e % 5}", "r", f"b{e % 7}") for g in (1, 2) for e in range(30)], "graph_id int, edge_id int, src string, rel string, dst string")
    rows = G.shuffle_graph(edges, 7).collect()
    sorts = [x for p in plans for x in p.splitlines() if " Sort [" in x]
    assert sorts and not any("md5" in x for x in sorts)
    want = sorted(range(30), key=lambda e: hashlib.md5(f"7:edge:1:{e}".encode()).hexdigest())
    assert [r.edge_id for r in sorted(rows, key=lambda r: r.new_edge_id) if r.graph_id == 1] == want


def test_prepared_splits_are_searched_together(spark, monkeypatch):
    links = [(f"n{i}", "r1" if i % 2 else "r2", f"n{i + 1}") for i in range(12)]
    triples = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx long, src string, rel string, dst string")
    train, held = triples(links), triples([("n0", "r1", "n3"), ("n0", "r2", "gone"), ("n5", "r1", "n5")])
    names = spark.createDataFrame([("n0",)], "entity string")
    searches, search = [], Q.pair_distances
    monkeypatch.setattr(Q, "pair_distances", lambda *a, **k: searches.append(1) or search(*a, **k))
    p = prepare_questions(train, held, held.limit(0), names, "kg", n_candidates=2)
    assert len(searches) == 1
    for split, t in (("train", train), ("validation", held), ("test", held.limit(0))):
        alone = Q.relation_questions(t, P.adjacency(train), G.relation_vocab(train), split, 64, 2)
        assert sorted(map(str, p["questions"].filter(F.col("split") == split).collect())) == sorted(map(str, alone.collect()))
    stats = [(r.split, r.available, r.selected, r.distance_counts) for r in p["stats"].collect()]
    assert stats == [("train", 12, 12, {"1": 12}), ("validation", 3, 3, {"0": 1, "3": 1, "unreachable": 1}), ("test", 0, 0, {})]
