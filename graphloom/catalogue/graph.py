"""Queries on graph hygiene, ids, weights, distances and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import paths as P
from graphloom.plans import Scratch, dense_index
from graphloom.sources import table

from .registry import query
from .views import CLEAN, KG_MULTI, KG_SMALL, kg_multi, kg_small


@query(f"WITH {KG_MULTI}, {CLEAN} SELECT * FROM clean")
def triples_clean(spark: SparkSession, sf: str) -> DataFrame:
    return G.clean_edges(kg_multi(spark, sf))


@query(f"""WITH {KG_MULTI}, {CLEAN},
k AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY edge_id, rel) AS n FROM clean),
l AS (SELECT graph_id, rel, row_number() OVER (PARTITION BY graph_id ORDER BY edge_id, rel) AS n FROM kg_multi)
SELECT k.graph_id, k.edge_id, k.src, l.rel, k.dst FROM k JOIN l ON k.graph_id = l.graph_id AND k.n = l.n""")
def triples_clean_compat(spark: SparkSession, sf: str) -> DataFrame:
    return G.clean_edges_compat(kg_multi(spark, sf))


@query(f"""WITH {KG_SMALL},
dict AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS node_id FROM (SELECT 'C' || c_custkey AS entity FROM customer UNION ALL SELECT 'N' || n_nationkey FROM nation)),
seen AS (SELECT entity, min(place) AS place FROM (SELECT src AS entity, 2 * idx AS place FROM kg_small UNION ALL SELECT dst, 2 * idx + 1 FROM kg_small) GROUP BY entity)
SELECT node_id, entity, true AS in_dictionary FROM dict UNION ALL
SELECT (SELECT count(*) FROM dict) + row_number() OVER (ORDER BY place) - 1, entity, false FROM seen WHERE entity NOT IN (SELECT entity FROM dict)""")
def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity"))
    b = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity"))
    return G.node_ids(a.unionAll(b), kg_small(spark, sf))


@query(f"""WITH {KG_SMALL}, d AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS id FROM (SELECT src AS entity FROM kg_small UNION SELECT dst FROM kg_small))
SELECT idx, a.id AS src_id, src, rel, b.id AS dst_id, dst FROM kg_small JOIN d a ON a.entity = src JOIN d b ON b.entity = dst""")
def edge_ids(spark: SparkSession, sf: str) -> DataFrame:
    t = kg_small(spark, sf)
    return G.materialize_edges(t, G.node_ids(t.select(F.explode(F.array("src", "dst")).alias("entity")).distinct(), t))


@query(f"""WITH {KG_SMALL}, {KG_MULTI}
SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS rel_id FROM (SELECT rel FROM kg_small UNION SELECT rel FROM kg_multi)""")
def relation_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return G.relation_vocab(kg_small(spark, sf).select("rel").unionAll(kg_multi(spark, sf).select("rel")))


@query(f"""WITH {KG_SMALL}, {KG_MULTI}, m AS (SELECT DISTINCT rel FROM kg_multi WHERE rel NOT IN (SELECT rel FROM kg_small))
SELECT coalesce(string_agg(rel, ',' ORDER BY rel), '') AS relations, count(*) AS n FROM m""")
def unknown_relations(spark: SparkSession, sf: str) -> DataFrame:
    return G.unknown_relations(kg_small(spark, sf), kg_multi(spark, sf))


@query(f"WITH {KG_MULTI} SELECT DISTINCT graph_id, src, rel, dst FROM kg_multi")
def qa_subgraph_triples(spark: SparkSession, sf: str) -> DataFrame:
    return G.qa_subgraph(kg_multi(spark, sf))[0]


@query(f"""WITH {KG_MULTI}, n AS (SELECT graph_id, src AS node FROM kg_multi UNION SELECT graph_id, dst FROM kg_multi)
SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS node_id FROM n""")
def qa_subgraph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.qa_subgraph(kg_multi(spark, sf))[1]


_DEGREES = f"""WITH {KG_MULTI}, {CLEAN},
d AS (SELECT graph_id, node, sum(i) AS i, sum(o) AS o FROM (SELECT graph_id, src AS node, 0 AS i, 1 AS o FROM clean UNION ALL SELECT graph_id, dst, 1, 0 FROM clean) GROUP BY graph_id, node),
nw AS (SELECT graph_id, node, 1.0::DOUBLE / (greatest(i, 1) + greatest(o, 1)) AS weight FROM d),
ew AS (SELECT graph_id, edge_id, src, rel, dst, 1.0::DOUBLE / sqrt((count(*) OVER (PARTITION BY graph_id, src) * count(*) OVER (PARTITION BY graph_id, dst))::DOUBLE) AS weight FROM clean)"""


@query(f"{_DEGREES} SELECT graph_id, node, round(weight, 9) AS weight FROM nw")
def node_weights(spark: SparkSession, sf: str) -> DataFrame:
    return G.node_weights(G.clean_edges(kg_multi(spark, sf))).withColumn("weight", F.round("weight", 9))


@query(f"{_DEGREES} SELECT graph_id, edge_id, src, rel, dst, round(weight, 9) AS weight FROM ew")
def edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    return G.edge_weights(G.clean_edges(kg_multi(spark, sf))).withColumn("weight", F.round("weight", 9))


UPSAMPLED = f"""{_DEGREES},
r AS (SELECT *, min(weight) OVER (PARTITION BY graph_id) AS lo, max(weight) OVER (PARTITION BY graph_id) AS hi FROM nw),
up AS (SELECT graph_id, node, (CASE WHEN lo = hi THEN 3 ELSE greatest(1, least(3, round_even((weight - lo) / (hi - lo) * 2 + 1, 0))) END)::INT AS copies FROM r)"""


@query(f"{UPSAMPLED} SELECT graph_id, node, copies FROM up")
def upsample_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = Scratch(spark, "upsample").save(G.node_weights(G.clean_edges(kg_multi(spark, sf))), "weights")
    return G.upsample_counts(w, ["graph_id"]).select("graph_id", "node", "copies")


@query(f"""WITH {KG_MULTI}, n AS (SELECT graph_id, src AS node FROM kg_multi UNION SELECT graph_id, dst FROM kg_multi),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5('7:node:' || graph_id || ':' || node), node) - 1 AS new FROM n),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5('7:edge:' || graph_id || ':' || edge_id), edge_id) - 1 AS new_edge_id FROM kg_multi)
SELECT e.graph_id, e.edge_id, new_edge_id, a.new AS new_src, b.new AS new_dst FROM e JOIN m a ON a.graph_id = e.graph_id AND a.node = e.src JOIN m b ON b.graph_id = e.graph_id AND b.node = e.dst""")
def shuffled_graph(spark: SparkSession, sf: str) -> DataFrame:
    return G.shuffle_graph(kg_multi(spark, sf), 7)


@query(f"""WITH {KG_MULTI}, {CLEAN} SELECT graph_id, '<graph>' || string_agg('<node>' || src || '</node><rel>' || rel || '</rel><node>' || dst || '</node>' || chr(10), '' ORDER BY edge_id) || '</graph>' AS sequence
FROM clean GROUP BY graph_id""")
def graph_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return G.edge_sequence(G.clean_edges(kg_multi(spark, sf)))


@query(f"""WITH {KG_MULTI}, {CLEAN}, n AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS id FROM (SELECT graph_id, src AS node FROM clean UNION SELECT graph_id, dst FROM clean)),
a AS (SELECT graph_id, string_agg('<node>ID: ' || id || '. ' || node || '</node>' || chr(10), '' ORDER BY id) AS t FROM n GROUP BY graph_id),
b AS (SELECT c.graph_id, string_agg('<rel>Node ' || x.id || ' and node ' || y.id || ' has relation ' || rel || '</rel>' || chr(10), '' ORDER BY edge_id) AS t
      FROM clean c JOIN n x ON x.graph_id = c.graph_id AND x.node = src JOIN n y ON y.graph_id = c.graph_id AND y.node = dst GROUP BY c.graph_id)
SELECT a.graph_id, '<graph>' || a.t || b.t || '</graph>' AS sequence FROM a JOIN b ON a.graph_id = b.graph_id""")
def indexed_sequence(spark: SparkSession, sf: str) -> DataFrame:
    e = G.clean_edges(kg_multi(spark, sf))
    return G.indexed_sequence(e, G.qa_subgraph(e)[1])


#: Walks from every nation of up to 4 steps without repeats; distances from a nation are 3 at most.
REACHED = f"""WITH RECURSIVE {KG_SMALL},
adj AS (SELECT src AS node, dst AS next FROM kg_small UNION SELECT dst, src FROM kg_small),
walk AS (SELECT 'N' || n_nationkey AS source, 'N' || n_nationkey AS node, 0 AS d, ['N' || n_nationkey] AS path FROM nation
  UNION ALL SELECT w.source, a.next, d + 1, list_append(path, a.next) FROM walk w JOIN adj a ON a.node = w.node WHERE d < 4 AND NOT list_contains(path, a.next)),
best AS (SELECT source, node, min(d) AS distance FROM walk GROUP BY source, node),
reached AS (SELECT w.source, w.node, w.d AS distance, min(w.path) AS path FROM walk w JOIN best b ON w.source = b.source AND w.node = b.node AND w.d = b.distance GROUP BY w.source, w.node, w.d)"""


def _reached(spark: SparkSession, sf: str, paths: bool = False) -> DataFrame:
    sources = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("source"))
    return P.bfs(P.adjacency(kg_small(spark, sf)), sources, paths=paths, symmetric=True)


#: Customers and their regions; nations of customers and of suppliers, which meet in one nation, in a region or not at all.
_MEETINGS = """WITH s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier),
p AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN s ON i = c_custkey % n),
q AS (SELECT 'N' || a AS source, 'N' || b AS target, CASE WHEN a = b THEN ['N' || a] WHEN x.n_regionkey = y.n_regionkey THEN ['N' || a, 'R' || x.n_regionkey, 'N' || b] END AS path
  FROM p JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b
  UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey, ['C' || c_custkey, 'N' || n_nationkey, 'R' || n_regionkey] FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"{_MEETINGS} SELECT source, target, len(path)::INT - 1 AS distance, array_to_string(path, '>') AS path FROM q WHERE path IS NOT NULL")
def pair_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest paths from both ends, past nations with thousands of customers."""
    s, c, n = (table(spark, sf, t) for t in ("supplier", "customer", "nation"))
    numbered = dense_index(s.select("s_suppkey", "s_nationkey"), "i", ["s_suppkey"])
    name = lambda prefix, k: F.concat(F.lit(prefix), F.col(k).cast("string"))
    nations = c.select("c_nationkey", (F.col("c_custkey") % s.count()).alias("i")).join(numbered, "i").select(name("N", "c_nationkey").alias("source"), name("N", "s_nationkey").alias("target"))
    homes = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(name("C", "c_custkey").alias("source"), name("R", "n_regionkey").alias("target"))
    return P.pair_paths(P.adjacency(kg_small(spark, sf)), nations.unionAll(homes)).withColumn("path", F.array_join("path", ">"))


#: The triples, nations of each region, and a ring of all nations: directed cycles of many lengths.
CYCLES = """cyc AS (SELECT src, dst FROM kg_small UNION SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation UNION SELECT 'N' || n_nationkey, 'N' || ((n_nationkey + 1) % 25) FROM nation)"""


@query(f"""WITH RECURSIVE {KG_SMALL}, {CYCLES}, walk AS (SELECT DISTINCT src AS source, src AS node, 0 AS d FROM cyc
  UNION SELECT w.source, c.dst, d + 1 FROM walk w JOIN cyc c ON c.src = w.node WHERE d < 12)
SELECT source, node, min(d)::INT AS distance FROM walk GROUP BY source, node""")
def bfs_directed(spark: SparkSession, sf: str) -> DataFrame:
    """Distances from every node with a way out."""
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    edges = kg_small(spark, sf).select("src", "dst").unionAll(n.select(name("R", F.col("n_regionkey")), name("N", k))).unionAll(n.select(name("N", k), name("N", (k + 1) % 25)))
    return P.bfs(P.adjacency(edges, directed=True), edges.select(F.col("src").alias("source")).distinct())


@query(f"{REACHED} SELECT source, node, distance FROM reached")
def bfs_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _reached(spark, sf)


@query(f"{REACHED} SELECT source, node, distance, array_to_string(path, '>') AS path FROM reached")
def bfs_path(spark: SparkSession, sf: str) -> DataFrame:
    return _reached(spark, sf, paths=True).withColumn("path", F.array_join("path", ">"))


@query(f"""{REACHED}, l AS (SELECT DISTINCT source, unnest(range(6)) AS depth FROM reached)
SELECT l.source, l.depth::INT AS depth, coalesce(string_agg(node, ',' ORDER BY node), '') AS nodes FROM l LEFT JOIN reached r ON r.source = l.source AND r.distance = l.depth GROUP BY l.source, l.depth""")
def bfs_frontiers(spark: SparkSession, sf: str) -> DataFrame:
    return P.frontiers(_reached(spark, sf), 5).withColumn("nodes", F.array_join("nodes", ","))


@query(f"""{REACHED}, pairs AS (SELECT source, target FROM (SELECT DISTINCT source FROM reached), (SELECT 'R' || unnest(range(7)) AS target))
SELECT coalesce(distance::VARCHAR, 'unreachable') AS distance, count(*) AS n FROM pairs LEFT JOIN reached r ON r.source = pairs.source AND r.node = pairs.target GROUP BY 1""")
def distance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    reached = Scratch(spark, "histogram").save(_reached(spark, sf), "reached")
    targets = F.explode(F.array(*[F.lit(f"R{i}") for i in range(7)]))
    pairs = reached.select("source").distinct().withColumn("node", targets)
    return P.distance_histogram(pairs.join(reached, ["source", "node"], "left"))


@query(f"""WITH {KG_SMALL}, h0 AS (SELECT 'C' || c_custkey AS query, 'C' || c_custkey AS node FROM customer),
h1 AS (SELECT query, node FROM h0 UNION SELECT query, dst FROM h0 JOIN kg_small ON src = node),
h2 AS (SELECT query, node FROM h1 UNION SELECT query, dst FROM h1 JOIN kg_small ON src = node)
SELECT a.query, idx AS edge_id, src, rel, dst FROM kg_small JOIN h2 a ON a.node = src JOIN h2 b ON b.query = a.query AND b.node = dst""")
def khop_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    edges = kg_small(spark, sf).withColumnRenamed("idx", "edge_id")
    name = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    return P.khop_subgraph(edges, table(spark, sf, "customer").select(name.alias("query"), name.alias("node")), hops=2)


@query(f"""WITH {KG_SMALL}, e AS (SELECT dst AS src, src AS dst FROM kg_small),
h1 AS (SELECT r.q AS query, dst AS node FROM (SELECT DISTINCT 'R' || n_regionkey AS q FROM nation) r JOIN e ON src = q),
k1 AS (SELECT * FROM h1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY md5('0:hop1:' || query || ':' || node), node) <= 2),
h2 AS (SELECT DISTINCT query, dst AS node FROM k1 JOIN e ON src = node),
k2 AS (SELECT * FROM h2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY md5('0:hop2:' || query || ':' || node), node) <= 2)
SELECT DISTINCT 'R' || n_regionkey AS query, 'R' || n_regionkey AS node FROM nation UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2""")
def khop_sampled_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = kg_small(spark, sf).select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    roots = table(spark, sf, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("query")).distinct()
    return P.khop_nodes(e, roots.withColumn("node", F.col("query")), hops=2, cap=2)


SCENE = """obj AS (
  SELECT l_orderkey AS image_id, l_linenumber * 10000000 + l_partkey AS object_id,
         trim(CASE WHEN l_linestatus = 'O' THEN l_returnflag || ', ' || l_linestatus ELSE '' END || ' part' || (l_partkey % 10) || ' at coordinate (' || l_linenumber || ', ' || (l_partkey % 100) || ') with width ' || (l_suppkey % 50) || ' and height 7') AS text,
         l_linenumber AS line FROM lineitem)"""


def _scene(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.functions.text import object_text

    attributes = F.when(F.col("l_linestatus") == "O", F.array("l_returnflag", "l_linestatus")).otherwise(F.array().cast("array<string>"))
    number = lambda c: F.col(c).cast("int")
    text = object_text(F.concat(F.lit("part"), (F.col("l_partkey") % 10).cast("string")), attributes, number("l_linenumber"), (F.col("l_partkey") % 100).cast("int"), (F.col("l_suppkey") % 50).cast("int"), F.lit(7))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") * 10**7 + F.col("l_partkey")).alias("object_id"), text.alias("text"), F.col("l_linenumber").alias("line"))


@query(f"WITH {SCENE} SELECT image_id, object_id, text FROM obj")
def scene_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _scene(spark, sf).drop("line")


@query(f"""WITH {SCENE}, o AS (SELECT DISTINCT image_id, object_id, text, line FROM obj)
SELECT a.image_id, a.object_id, 'before' AS rel, b.object_id AS target_id, a.text AS src, b.text AS dst FROM o a JOIN o b ON a.image_id = b.image_id AND b.line = a.line + 1""")
def scene_edges(spark: SparkSession, sf: str) -> DataFrame:
    o = _scene(spark, sf).distinct()
    nxt = o.select("image_id", (F.col("line") - 1).alias("line"), F.col("object_id").alias("target_id"))
    relations = o.join(nxt, ["image_id", "line"]).select("image_id", "object_id", F.lit("before").alias("rel"), "target_id").distinct()
    return G.scene_edges(o, relations)
