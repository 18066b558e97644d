"""Distances, paths and neighbourhoods by joins, all sources advancing together.

The state of a level is written to the shared scratch folder, which cuts the
lineage and lets Spark size the next join. The number of levels is the longest
distance, or ``max_depth``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.sample import hash_key, sample_per_group
from graphloom.plans import Scratch


def adjacency(edges: DataFrame, directed: bool = False, drop_loops: bool = True) -> DataFrame:
    """Distinct ``node, next``, both ways unless directed."""
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("next"))
    ways = F.array(way("src", "dst"), *([] if directed else [way("dst", "src")]))
    rows = edges.select(F.explode(ways).alias("w")).select("w.*").distinct()
    return rows.filter("node <> next") if drop_loops else rows


def bfs(neighbours: DataFrame, sources: DataFrame, max_depth: int | None = None, paths: bool = False, symmetric: bool = False) -> DataFrame:
    """``source, node, distance`` and, with ``paths``, the lexicographically least shortest ``path``.

    Breadth-first search that visits neighbours in sorted order reaches each node by that path: it is the least of its
    predecessors' least paths, extended. ``sources``: one column ``source``. A node is visited once. Where each
    neighbour is known to be one both ways (``symmetric``), only the last two levels need to be looked at for that.
    """
    scratch = Scratch(neighbours.sparkSession, "bfs")
    neighbours = scratch.save(neighbours, "neighbours")
    start = sources.select("source", F.col("source").alias("node"), F.lit(0).alias("distance"), *([F.array("source").alias("path")] if paths else []))
    frontier = scratch.save(start.distinct(), "level-0")
    reached, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(neighbours, "node")
        # with symmetric neighbours a neighbour of the last level lies on it, on the one before, or is new
        before = reached[-2:] if symmetric else reached
        near = before[0].select("source", "node")
        for level in before[1:]:
            near = near.unionAll(level.select("source", "node"))
        keys = ["source", F.col("next").alias("node")]
        if paths:
            step = step.groupBy(*keys).agg(F.min(F.array_append("path", F.col("next"))).alias("path"))
        else:
            step = step.select(*keys).distinct()
        new = step.join(near, ["source", "node"], "left_anti").withColumn("distance", F.lit(depth))
        frontier = scratch.save(new.select(*frontier.columns), f"level-{depth}")
        if frontier.isEmpty():
            break
        reached.append(frontier)
    out = reached[0]
    for level in reached[1:]:
        out = out.unionAll(level)
    return out


def pair_paths(neighbours: DataFrame, pairs: DataFrame, max_depth: int | None = None, written: list[int] | None = None) -> DataFrame:
    """``source, target, distance, path`` of the pairs with a path, the lexicographically least shortest one; each pair once.

    Every pair is searched from both ends, in a graph where neighbours are so both ways. A round extends, for each pair,
    the side whose last level has fewer edges, so that a hub is only expanded if all ways lead through it. The first
    level that meets the other side's last one settles the pair: its path is the least of the least halves. Settled pairs
    and those with an exhausted side leave the state, which holds two levels of each side of the others. Rounds go on
    until no pair is left, or to ``max_depth``. ``written`` gets the rows of each round's state.

    A node of one neighbour lies on no way but as its end, so that a hub of any number of leaves is extended only to its
    other neighbours, and to the pair's other end where that is one of its leaves.
    """
    scratch = Scratch(neighbours.sparkSession, "pairs")
    neighbours = scratch.save(neighbours, "given")
    degree = neighbours.groupBy("node").agg(F.count("*").alias("degree"))
    degree = scratch.save(degree, "degrees")
    leaves = degree.filter("degree = 1").select(F.col("node").alias("next"))
    inner = scratch.save(neighbours.join(degree.filter("degree > 1").select(F.col("node").alias("next")), "next").select("node", "next"), "inner")
    # neighbours that are no leaves are what an extension costs
    degree = scratch.save(degree.select("node").join(inner.groupBy("node").agg(F.count("*").alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree")), "costs")
    near = scratch.save(inner.join(degree.select(F.col("node").alias("next"), "degree"), "next").select("node", "next", "degree"), "neighbours")
    pairs = scratch.save(pairs.select("source", "target").distinct(), "asked")
    path = lambda c: F.array(c).alias("path")
    trivial = pairs.filter("source = target").select("source", "target", F.lit(0).alias("distance"), path("source"))
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("node")) for k, c in enumerate(("source", "target"))])).alias("e")
    start = pairs.filter("source <> target").select("source", "target", ends).select("source", "target", "e.*")
    # an end without edges has no row here, and its pair no path
    start = start.join(degree, "node").select("source", "target", "side", "node", path("node"), F.lit(0).alias("age"), F.lit(0).alias("depth"), "degree")
    # the leaf that an end is: its only neighbour and what it costs
    asked = start.select(F.col("node").alias("next")).distinct().join(leaves, "next")
    leaf = scratch.save(neighbours.join(asked, "next").join(degree.select(F.col("node").alias("next"), "degree"), "next").select("node", "next", "degree"), "leaves")
    state, found, depth = scratch.save(start, "state-0"), [scratch.save(trivial, "settled-0")], 0
    names, pair, node_type = state.columns, ["source", "target"], state.schema["node"].dataType
    while not state.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        last = state.filter("age = 0")
        cost = lambda k: F.sum(F.when(F.col("side") == k, F.col("degree")))
        # with one side missing the pair isn't chosen
        chosen = last.groupBy(*pair).agg(cost(0).alias("_a"), cost(1).alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL")
        chosen = chosen.select(*pair, F.when(F.col("_a") <= F.col("_b"), 0).otherwise(1).alias("_side"))
        step = last.join(chosen, pair).filter("side = _side").select(*pair, "side", "node", "path", "depth")
        end = F.when(F.col("side") == 0, F.col("target")).otherwise(F.col("source"))
        at_end = step.withColumn("next", end).join(leaf, ["node", "next"])
        step = step.join(near, "node").unionByName(at_end)
        step = step.groupBy(*pair, "side", F.col("next").alias("node")).agg(F.min("path").alias("path"), F.max("depth").alias("depth"), F.max("degree").alias("degree"))
        new = step.join(state.select(*pair, "side", "node"), [*pair, "side", "node"], "left_anti")
        longer = F.when(F.col("side") == 0, F.array_append("path", F.col("node"))).otherwise(F.array_prepend("path", F.col("node")))
        new = new.select(*pair, "side", "node", longer.alias("path"), F.lit(0).alias("age"), (F.col("depth") + 1).alias("depth"), "degree")
        other = last.select(*pair, (1 - F.col("side")).alias("side"), "node", F.col("path").alias("_other"))
        tail = lambda c: F.slice(c, F.lit(2), F.size(c))
        whole = F.when(F.col("side") == 0, F.concat("path", tail("_other"))).otherwise(F.concat("_other", tail("path")))
        new = scratch.save(new.join(other, [*pair, "side", "node"], "left").withColumn("whole", whole).drop("_other"), f"new-{depth}")
        # what a pair's round has come to: its side, and its path if the halves have met
        round_ = new.groupBy(*pair).agg(F.max("side").alias("_side"), F.min("whole").alias("_whole"))
        settled = round_.filter("_whole IS NOT NULL").select(*pair, F.lit(None).cast("int").alias("side"), F.lit(None).cast(node_type).alias("node"), F.col("_whole").alias("path"), F.lit(-1).alias("age"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("degree"))
        # the level before the last of a side that moved is no longer needed
        kept = state.join(round_.filter("_whole IS NULL"), pair).withColumn("age", F.col("age") + (F.col("side") == F.col("_side")).cast("int")).filter("age < 2").select(*names)
        fresh = new.join(round_.filter("_whole IS NULL").select(*pair), pair, "left_semi").select(*names)
        parts = settled.unionByName(kept).unionByName(fresh).withColumn("live", F.col("age") >= 0)
        rows = scratch.save(parts, f"state-{depth}", ["live"])
        found.append(rows.filter("NOT live").select(*pair, (F.size("path") - 1).alias("distance"), "path"))
        state = rows.filter("live").select(*names)
        scratch.drop(*([f"state-{depth - 1}/live=true"] if depth > 1 else ["state-0"]), f"new-{depth}")
        if written is not None:
            written.append(state.count())
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


#: Rows of all sources' distances up to which flooding takes less than rounds from both ends.
FLOOD_ROWS = 50_000_000


def pair_distances(neighbours: DataFrame, pairs: DataFrame, max_depth: int | None = None, symmetric: bool = False, both_ends: bool | None = None) -> DataFrame:
    """Adds ``distance``, ``path``, ``reachable`` and ``true_hop`` to ``source, target``.

    An entity reaches itself at distance 0 even if it has no edge; a hop is a distance of 1 or more. Where each
    neighbour is known to be one both ways (``symmetric``), pairs are searched from both ends if all sources together
    could reach more than ``FLOOD_ROWS`` nodes, or as ``both_ends`` says; the rows are the same.
    """
    sources = pairs.select("source").distinct()
    if symmetric and both_ends is None:
        scratch = Scratch(neighbours.sparkSession, "distances")
        neighbours, sources = scratch.save(neighbours, "neighbours"), scratch.save(sources, "sources")
        both_ends = sources.count() * neighbours.count() > FLOOD_ROWS
    if symmetric and both_ends:
        reached = pair_paths(neighbours, pairs, max_depth)
    else:
        reached = bfs(neighbours, sources, max_depth, paths=True, symmetric=symmetric).withColumnRenamed("node", "target")
    out = pairs.join(reached, ["source", "target"], "left")
    reachable = F.col("distance").isNotNull()
    return out.withColumns({"reachable": reachable, "true_hop": F.when(F.col("distance") >= 1, F.col("distance"))})


def frontiers(reached: DataFrame, max_depth: int) -> DataFrame:
    """``source, depth, nodes``: sorted nodes at each exact distance from 0 to ``max_depth``, empty ones included."""
    levels = reached.select("source").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    nodes = reached.groupBy("source", F.col("distance").alias("depth")).agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return levels.join(nodes, ["source", "depth"], "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<string>")))


def distance_histogram(distances: DataFrame) -> DataFrame:
    """``distance, n`` with 'unreachable' for none."""
    return distances.groupBy(F.coalesce(F.col("distance").cast("string"), F.lit("unreachable")).alias("distance")).agg(F.count("*").alias("n"))


def khop_nodes(edges: DataFrame, roots: DataFrame, hops: int = 3, cap: int | None = None, seed: int = 0) -> DataFrame:
    """``query, node``: nodes within ``hops`` directed steps of a query's roots.

    With ``cap`` at most so many distinct new nodes join a query per hop, by hash order; those left out count as
    visited and aren't met again. ``roots``: query, node.
    """
    scratch = Scratch(edges.sparkSession, "khop")
    next_ = scratch.save(adjacency(edges, directed=True), "next")
    kept = scratch.save(roots.select("query", "node").distinct(), "hop-0")
    visited, frontier = kept, kept
    for hop in range(1, hops + 1):
        new = frontier.join(next_, "node").select("query", F.col("next").alias("node")).distinct()
        fringe = scratch.save(new.join(visited, ["query", "node"], "left_anti"), f"fringe-{hop}")
        visited = visited.unionAll(fringe)
        frontier = fringe
        if cap is not None:
            order = [hash_key(seed, f"hop{hop}", F.col("query"), F.col("node")), "node"]
            frontier = scratch.save(sample_per_group(fringe, ["query"], order, cap), f"hop-{hop}")
        kept = kept.unionAll(frontier)
    return kept


def khop_subgraph(edges: DataFrame, roots: DataFrame, hops: int = 3, cap: int | None = None, seed: int = 0) -> DataFrame:
    """``query, edge_id, src, rel, dst``: edges among a query's nodes, parallel ones included."""
    nodes = Scratch(edges.sparkSession, "khop-nodes").save(khop_nodes(edges, roots, hops, cap, seed), "nodes")
    inner = edges.join(nodes.withColumnRenamed("node", "src"), "src")
    return inner.join(nodes.withColumnRenamed("node", "dst"), ["query", "dst"], "left_semi").select("query", "edge_id", "src", "rel", "dst")
