"""Graph hygiene, ids, weights and renderings. Edges are rows ``graph_id, edge_id, src, rel, dst``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.sample import hash_key
from graphloom.plans import Scratch, dense_index, dense_index_by

UNKNOWN = "Unknown"


def clean_edges(edges: DataFrame, by_source: bool = False) -> DataFrame:
    """Without loops and repeated (src, dst) pairs, the first of each kept with its own label. One partial aggregate;
    ``by_source`` deals the edges by their source before it, for callers that need them there anyway."""
    first = F.min(F.struct("edge_id", "rel")).alias("first")
    rows = edges.filter(F.col("src") != F.col("dst"))
    rows = rows.repartition("graph_id", "src") if by_source else rows
    kept = rows.groupBy("graph_id", "src", "dst").agg(first)
    return kept.select("graph_id", F.col("first.edge_id").alias("edge_id"), "src", F.col("first.rel").alias("rel"), "dst")


def clean_edges_compat(edges: DataFrame) -> DataFrame:
    """As ``clean_edges``, but the k-th kept edge has the label of the graph's k-th edge (shifted labels)."""
    number = lambda df: dense_index_by(df, ["graph_id"], "k", ["edge_id", "rel"])
    labels = number(edges.select("graph_id", "edge_id", "rel")).drop("edge_id")
    kept = number(clean_edges(edges)).drop("rel")
    return kept.join(labels, ["graph_id", "k"]).select("graph_id", "edge_id", "src", "rel", "dst")


def node_ids(dictionary: DataFrame, triples: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """``node_id, entity, in_dictionary``: dictionary entries in order, of their names or of ``pos`` in ``places``, then
    entities seen only in triples, in order of first sight, heads before tails."""
    known = dense_index(dictionary.select("entity"), "node_id", ["entity"]) if places is None else dense_index(places, "node_id", ["pos"]).drop("pos")
    n = known.count()
    seen = triples.select(F.explode(F.array(F.struct(F.col("src").alias("entity"), (2 * F.col("idx")).alias("at")), F.struct(F.col("dst").alias("entity"), (2 * F.col("idx") + 1).alias("at")))).alias("s")).select("s.*")
    unseen = seen.groupBy("entity").agg(F.min("at").alias("at")).join(known, "entity", "left_anti")
    unknown = dense_index(unseen, "node_id", ["at"]).select((F.col("node_id") + n).alias("node_id"), "entity", F.lit(False).alias("in_dictionary"))
    return known.select("node_id", "entity", F.lit(True).alias("in_dictionary")).unionAll(unknown)


def relation_vocab(triples: DataFrame) -> DataFrame:
    """``rel_id, rel`` of the distinct relations in order. The vocabulary has a row for each relation."""
    return triples.select("rel").distinct().withColumn("rel_id", (F.row_number().over(W.orderBy("rel")) - 1).cast("long"))


def unknown_relations(train: DataFrame, other: DataFrame) -> DataFrame:
    """One row: sorted relations of ``other`` that ``train`` lacks."""
    missing = other.select("rel").distinct().join(train.select("rel").distinct(), "rel", "left_anti")
    return missing.agg(F.array_join(F.array_sort(F.collect_set("rel")), ",").alias("relations"), F.count("*").alias("n"))


def require_known_relations(train: DataFrame, other: DataFrame) -> None:
    """Raises if ``other`` has relations that ``train`` lacks."""
    r = unknown_relations(train, other).first()
    if r.n:
        raise ValueError(f"relations outside of the training vocabulary: {r.relations}")


def materialize_edges(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids of both endpoints by two equi-joins."""
    ids = nodes.select("entity", "node_id")
    source = ids.select(F.col("entity").alias("src"), F.col("node_id").alias("src_id"))
    target = ids.select(F.col("entity").alias("dst"), F.col("node_id").alias("dst_id"))
    return triples.join(source, "src").join(target, "dst").select("idx", "src_id", "src", "rel", "dst_id", "dst")


def qa_subgraph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct triples of each graph, and its nodes numbered in order."""
    triples = edges.select("graph_id", "src", "rel", "dst").distinct()
    ends = triples.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return triples, dense_index_by(ends, ["graph_id"], "node_id", ["node"])


def degrees(edges: DataFrame) -> DataFrame:
    """``graph_id, node, n_in, n_out`` of nodes with edges, in one aggregate. Ends are dealt by node before they are counted:
    few of them meet in a task before that, and a table of those would only take its memory."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    rows = edges.select("graph_id", F.explode(ends).alias("e")).select("graph_id", "e.*").repartition("graph_id", "node")
    return rows.groupBy("graph_id", "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def node_weights(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """1 / (in + out), where a degree of 0 counts as 1; ``nodes`` adds isolated ones."""
    d = degrees(edges)
    if nodes is not None:
        d = nodes.select("graph_id", "node").join(d, ["graph_id", "node"], "left")
    return d.select("graph_id", "node", _node_weight(F.col("n_out"), F.col("n_in")).alias("weight"))


def _node_weight(n_out: Column, n_in: Column) -> Column:
    one = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(1))
    return 1.0 / (one(n_in) + one(n_out))


def _edge_weight(n_out: Column, n_in: Column) -> Column:
    return 1.0 / F.sqrt((n_out * n_in).cast("double"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """1 / sqrt(out(src) * in(dst)). An edge is dealt to its source and then to its target, and counted there."""
    n = lambda end: F.count("*").over(W.partitionBy("graph_id", end))
    rows = edges.withColumn("_o", n("src")).withColumn("_i", n("dst"))
    return rows.select("graph_id", "edge_id", "src", "rel", "dst", _edge_weight(F.col("_o"), F.col("_i")).alias("weight"))


def weights(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node_weights`` and ``edge_weights`` together, of edges without loops.

    Edges are dealt to their sources (where ``clean_edges`` with ``by_source`` has left them) and counted, then with a row
    for each source to their targets, where both degrees of a node meet. The table is written once for both.
    """
    whole = lambda w: w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_src = W.partitionBy("graph_id", "src").orderBy("dst")
    rows = edges.withColumns({"_o": F.count("*").over(whole(by_src)), "_first": F.row_number().over(by_src) == 1})
    edge = F.struct(F.col("dst").alias("node"), "edge_id", "src", "rel", "_o")
    none = lambda c: F.lit(None).cast(edges.schema[c].dataType).alias(c)
    source = F.struct(F.col("src").alias("node"), none("edge_id"), none("src"), none("rel"), "_o")
    ends = F.when(F.col("_first"), F.array(source, edge)).otherwise(F.array(edge))
    rows = rows.select("graph_id", F.explode(ends).alias("e")).select("graph_id", "e.*").repartition("graph_id", "node")
    by_node = W.partitionBy("graph_id", "node").orderBy("edge_id")
    is_edge = F.col("src").isNotNull()
    n_in = F.count("src").over(whole(by_node))
    n_out = F.max(F.when(~is_edge, F.col("_o"))).over(whole(by_node))
    rows = rows.withColumns({"_in": n_in, "_out": n_out, "_k": F.row_number().over(by_node)}).select(
        "graph_id", "node", "edge_id", "src", "rel", F.when(is_edge, _edge_weight(F.col("_o"), F.col("_in"))).alias("edge_weight"),
        F.when(F.col("_k") == 1, _node_weight(F.col("_out"), F.col("_in"))).alias("node_weight"),
    )
    rows = Scratch(edges.sparkSession, "weights").save(rows, "rows")
    nodes = rows.filter("node_weight IS NOT NULL").select("graph_id", "node", F.col("node_weight").alias("weight"))
    return nodes, rows.filter("src IS NOT NULL").select("graph_id", "edge_id", "src", "rel", F.col("node").alias("dst"), F.col("edge_weight").alias("weight"))


def upsample_counts(weighted: DataFrame, group: list[str], clip: int = 3) -> DataFrame:
    """Adds ``copies``: weights rescaled to [1, clip] by group, rounded half to even; all equal gives clip.

    Weights are read twice, so they should be written ones. The groups' spans are written, so that Spark sees their size
    and moves no weights to join them."""
    span = weighted.groupBy(*group).agg(F.min("weight").alias("_low"), F.max("weight").alias("_high"))
    span = Scratch(weighted.sparkSession, "span").save(span, "span")
    scaled = (F.col("weight") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (clip - 1) + 1
    copies = F.when(F.col("_high") == F.col("_low"), F.lit(float(clip))).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(float(clip)), F.bround(scaled))))
    return weighted.join(span, group).withColumn("copies", copies.cast("int")).drop("_low", "_high")


def shuffle_graph(edges: DataFrame, seed: int) -> DataFrame:
    """Nodes and edges of each graph renumbered in hash order: ``graph_id, edge_id, new_edge_id, new_src, new_dst``."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    number = lambda df, name, scope, key: dense_index_by(df, ["graph_id"], name, [F.unhex(hash_key(seed, scope, F.col("graph_id"), F.col(key))), key])
    new = number(ends, "new", "node", "node")
    rows = number(edges, "new_edge_id", "edge", "edge_id")
    for end in ("src", "dst"):
        rows = rows.join(new.select("graph_id", F.col("node").alias(end), F.col("new").alias(f"new_{end}")), ["graph_id", end])
    return rows.select("graph_id", "edge_id", "new_edge_id", "new_src", "new_dst")


def edge_sequence(edges: DataFrame) -> DataFrame:
    """Tagged text of each graph, edges in order."""
    line = F.concat(F.lit("<node>"), "src", F.lit("</node><rel>"), "rel", F.lit("</rel><node>"), "dst", F.lit("</node>\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", line.alias("line")))), lambda x: x["line"]), "")
    return edges.groupBy("graph_id").agg(F.concat(F.lit("<graph>"), lines, F.lit("</graph>")).alias("sequence"))


def indexed_sequence(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Text of each graph by node numbers: a line for each node, then one for each edge. ``nodes``: graph_id, node, node_id."""
    by_place = lambda key, line: F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))), lambda x: x["line"])
    node_line = F.concat(F.lit("<node>ID: "), F.col("node_id").cast("string"), F.lit(". "), "node", F.lit("</node>\n"))
    node_lines = nodes.groupBy("graph_id").agg(by_place("node_id", node_line).alias("node_lines"))
    rows = edges
    for end in ("src", "dst"):
        rows = rows.join(nodes.select("graph_id", F.col("node").alias(end), F.col("node_id").alias(f"{end}_id")), ["graph_id", end])
    edge_line = F.concat(F.lit("<rel>Node "), F.col("src_id").cast("string"), F.lit(" and node "), F.col("dst_id").cast("string"), F.lit(" has relation "), "rel", F.lit("</rel>\n"))
    edge_lines = rows.groupBy("graph_id").agg(by_place("edge_id", edge_line).alias("edge_lines"))
    return node_lines.join(edge_lines, "graph_id").select("graph_id", F.concat(F.lit("<graph>"), F.array_join(F.concat("node_lines", "edge_lines"), ""), F.lit("</graph>")).alias("sequence"))


def scene_edges(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations of scene objects with both texts: ``image_id, object_id, rel, target_id, src, dst``."""
    text = objects.select("image_id", "object_id", "text")
    target = text.select("image_id", F.col("object_id").alias("target_id"), F.col("text").alias("dst"))
    return relations.join(text.withColumnRenamed("text", "src"), ["image_id", "object_id"]).join(target, ["image_id", "target_id"]).select("image_id", "object_id", "rel", "target_id", "src", "dst")


def question_metadata(given: Column, fallback: Column) -> Column:
    """The given metadata value, else that of the parallel array."""
    return F.coalesce(given, fallback)
