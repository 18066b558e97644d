import random
from collections import Counter
from itertools import combinations

from graphloom.operators import rules as R

EDGES = "src string, rel string, dst string"


def random_edges(seed, n_nodes=14, n=70):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n_nodes)}", rng.choice("pqr"), f"n{rng.randrange(n_nodes)}") for _ in range(n)]
    # a hub with edges to and from all
    return rows + [("hub", "p", f"n{k}") for k in range(n_nodes)] + [(f"n{k}", "q", "hub") for k in range(0, n_nodes, 2)] + [(None, "p", "n1"), ("n1", None, "n2")]


def slow_rules(rows):
    e = {(a, r, b) for a, r, b in rows if None not in (a, r, b) and a != b}
    size = Counter(r for _, r, _ in e)
    inverse = Counter((r, h) for a, r, b in e for x, h, y in e if (x, y) == (b, a))
    ways = [(r, s, a, z) for a, r, b in e for y, s, z in e if y == b and z != a]
    total = Counter((r, s) for r, s, _, _ in ways)
    composed = Counter((r, s, h) for r, s, a, z in ways for x, h, y in e if (x, y) == (a, z))
    out = {("inverse", r, None, h): (n, size[r]) for (r, h), n in inverse.items()}
    return out | {("composition", r, s, h): (n, total[r, s]) for (r, s, h), n in composed.items()}


def test_rules_against_nested_loops(spark):
    rows = random_edges(3)
    found = R.relation_rules(spark.createDataFrame(rows + rows[:9], EDGES)).collect()
    assert {(r.kind, r.r1, r.r2, r.head): (r.support, r.total) for r in found} == slow_rules(rows)
    assert len(found) == len(slow_rules(rows)) and all(r.confidence == r.support / r.total for r in found)
    assert R.relation_rules(spark.createDataFrame([], EDGES)).collect() == []


def test_triangles_once_and_not_from_the_hub(spark):
    rows = [(a, b) for a, _, b in random_edges(5) if a and b and a != b]
    found = [frozenset(r) for r in R.triangles(spark.createDataFrame(rows, "src string, dst string")).collect()]
    links = {frozenset(p) for p in rows}
    nodes = sorted(set().union(*links))
    assert Counter(found) == Counter(frozenset(t) for t in combinations(nodes, 3) if all(frozenset(p) in links for p in combinations(t, 2)))


def test_shortcuts(spark):
    graph = [("a", "born", "c"), ("b", "born", "c"), ("a", "cit", "k"), ("b", "cit", "k"), ("c", "in", "k"), ("d", "born", "c"), ("m", "wife", "h"), ("h", "husband", "m"), ("v", "wife", "w"), ("w", "husband", "v"), ("x", "wife", "y")]
    edges = spark.createDataFrame(graph, EDGES)
    rules = R.relation_rules(edges)
    q = [("1", "d", "k", "cit", 3), ("2", "d", "k", "cit", 2), ("3", "a", "k", "cit", 3), ("4", "y", "x", "husband", 2), ("5", "y", "x", "husband", None), ("6", "zz", "k", "cit", 4), ("7", "d", "k", "in", 3)]
    texts = spark.createDataFrame([("y", "The Y of X"), ("x", "x"), ("d", ""), ("k", "K")], "entity string, text string")
    found = {r.question_id: tuple(r)[1:] for r in R.shortcut_checks(spark.createDataFrame(q, "question_id string, source string, target string, answer string, true_hop int"), edges, rules, texts).collect()}
    no = False
    assert found == {
        "1": (no, no, no, True), "2": (no, no, no, no), "3": (True, no, no, True), "4": (no, True, True, True), "5": (no, True, True, no), "6": (no, no, no, no), "7": (no, no, no, no),
    }
