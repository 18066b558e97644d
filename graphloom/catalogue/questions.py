"""Queries on samples, candidates, questions and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import graph as G
from graphloom.operators import paths as P
from graphloom.operators import questions as Q
from graphloom.operators import sample as S
from graphloom.plans import Scratch
from graphloom.sources import table

from .registry import query
from .views import CLEAN, KG_MULTI, KG_SMALL, kg_multi, kg_small

SEED = Q.SEED


@query(f"WITH {KG_SMALL} SELECT * FROM kg_small ORDER BY md5('2026:train:' || idx), idx LIMIT 64")
def sample_questions(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_rows(kg_small(spark, sf), SEED, "train", ["idx"], 64)


@query(f"""WITH {KG_MULTI}, {CLEAN} SELECT graph_id, edge_id, rel FROM clean
QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY md5('2026:cap:' || graph_id || ':' || edge_id), edge_id, rel) <= 3""")
def sample_per_graph(spark: SparkSession, sf: str) -> DataFrame:
    key = S.hash_key(SEED, "cap", F.col("graph_id"), F.col("edge_id"))
    return S.sample_per_group(G.clean_edges(kg_multi(spark, sf)), ["graph_id"], [key, "edge_id", "rel"], 3).select("graph_id", "edge_id", "rel")


def _unit(key: str) -> str:
    """SQL of ``uniform``."""
    digits = " + ".join(f"(strpos('0123456789abcdef', substr({key}, {i + 1}, 1)) - 1)::BIGINT * {16 ** (11 - i)}" for i in range(12))
    return f"(({digits} + 1)::DOUBLE / 281474976710656.0)"


@query(f"""WITH {KG_MULTI}, {CLEAN}, o AS (SELECT graph_id, src, count(*) AS w FROM clean GROUP BY graph_id, src),
k AS (SELECT *, md5('3:es:' || graph_id || ':' || src) AS h FROM o)
SELECT graph_id, src FROM k QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY -ln({_unit('h')}) / w, graph_id, src) <= 2""")
def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    nodes = G.clean_edges(kg_multi(spark, sf)).groupBy("graph_id", "src").agg(F.count("*").alias("w"))
    return S.sample_weighted(nodes, ["graph_id"], ["graph_id", "src"], "w", 2, 3, "es", strict=False).select("graph_id", "src")


@query(f"""WITH {KG_MULTI}, {CLEAN}, o AS (SELECT graph_id, src, count(*) AS w FROM clean GROUP BY graph_id, src),
c AS (SELECT *, sum(w) OVER (PARTITION BY graph_id ORDER BY src) AS upto, sum(w) OVER (PARTITION BY graph_id) AS total FROM o),
d AS (SELECT graph_id, draw, md5('3:wr:' || graph_id || ':' || draw) AS h FROM (SELECT DISTINCT graph_id FROM o), (SELECT unnest(range(4)) AS draw))
SELECT c.graph_id, d.draw::INT AS draw, c.src FROM c JOIN d ON c.graph_id = d.graph_id AND upto - w <= (1 - {_unit('h')}) * total AND (1 - {_unit('h')}) * total < upto""")
def weighted_sample_replace(spark: SparkSession, sf: str) -> DataFrame:
    nodes = G.clean_edges(kg_multi(spark, sf)).groupBy("graph_id", "src").agg(F.count("*").alias("w"))
    return S.sample_weighted_replace(nodes, ["graph_id"], ["src"], "w", 4, 3, "wr").select("graph_id", "draw", "src")


VOCAB = "vocab AS (SELECT DISTINCT rel FROM (SELECT rel FROM kg_small UNION SELECT rel FROM kg_multi UNION SELECT 'placed_' || o_orderpriority FROM orders))"


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    placed = table(spark, sf, "orders").select(F.concat(F.lit("placed_"), "o_orderpriority").alias("rel"))
    return kg_small(spark, sf).select("rel").unionAll(kg_multi(spark, sf).select("rel")).unionAll(placed).distinct()


def _candidates_sql(rows: str, n: int) -> str:
    return f"""picked AS (SELECT q.question_id, v.rel FROM {rows} q JOIN vocab v ON v.rel <> q.answer
  QUALIFY row_number() OVER (PARTITION BY q.question_id ORDER BY md5('2026:cand:' || q.question_id || ':' || v.rel), v.rel) <= {n - 1}),
cands AS (SELECT question_id, list(rel ORDER BY md5('2026:cand-order:' || question_id || ':' || rel), rel) AS candidates
  FROM (SELECT * FROM picked UNION ALL SELECT question_id, answer FROM {rows}) GROUP BY question_id)"""


@query(f"""WITH {KG_SMALL}, {KG_MULTI}, {VOCAB}, q AS (SELECT src || '>' || dst AS question_id, rel AS answer FROM kg_small), {_candidates_sql('q', 4)}
SELECT q.question_id, answer, array_to_string(candidates, '|') AS candidates FROM q JOIN cands USING (question_id)""")
def candidate_relations(spark: SparkSession, sf: str) -> DataFrame:
    q = kg_small(spark, sf).select(F.concat_ws(">", "src", "dst").alias("question_id"), F.col("rel").alias("answer"))
    return Q.candidates(q, _vocab(spark, sf), 4, SEED).withColumn("candidates", F.array_join("candidates", "|"))


@query(f"""WITH {KG_SMALL}, {KG_MULTI}, {VOCAB}, q AS (SELECT src || '>' || dst AS question_id, rel AS answer FROM kg_small)
SELECT q.question_id, string_agg(rel, '|' ORDER BY md5('2026:cand-order:' || question_id || ':' || rel), rel) AS candidates FROM q, vocab GROUP BY q.question_id""")
def all_candidates(spark: SparkSession, sf: str) -> DataFrame:
    q = kg_small(spark, sf).select(F.concat_ws(">", "src", "dst").alias("question_id"), F.col("rel").alias("answer"))
    vocab = _vocab(spark, sf)
    return Q.candidates(q, vocab, max(2, vocab.count()), SEED).select("question_id", F.array_join("candidates", "|").alias("candidates"))


#: Held-out triples: some hold in the same region (distance 2), some not (4), some name an unknown region.
HELD = """held AS (SELECT c_custkey AS idx, 'C' || c_custkey AS src, 'part_of' AS rel, CASE WHEN c_custkey % 10 = 0 THEN 'R9' ELSE 'R' || (c_custkey % 5) END AS dst FROM customer)"""


def _held(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    dst = F.when(k % 10 == 0, "R9").otherwise(F.concat(F.lit("R"), (k % 5).cast("string")))
    return table(spark, sf, "customer").select(k.alias("idx"), F.concat(F.lit("C"), k.cast("string")).alias("src"), F.lit("part_of").alias("rel"), dst.alias("dst"))


@query(f"""WITH RECURSIVE {KG_SMALL}, {KG_MULTI}, {VOCAB}, {HELD},
q AS (SELECT 'kg:test:' || idx AS question_id, rel AS answer, src, dst, idx FROM held ORDER BY md5('2026:test:' || idx), idx LIMIT 32), {_candidates_sql('q', 5)},
adj AS (SELECT src AS node, dst AS next FROM kg_small UNION SELECT dst, src FROM kg_small),
walk AS (SELECT src AS source, src AS node, 0 AS d, [src] AS path FROM q
  UNION ALL SELECT w.source, a.next, d + 1, list_append(path, a.next) FROM walk w JOIN adj a ON a.node = w.node WHERE d < 4 AND NOT list_contains(path, a.next)),
best AS (SELECT source, node, min(d) AS distance FROM walk GROUP BY source, node),
r AS (SELECT w.source, w.node, w.d AS distance, min(w.path) AS path FROM walk w JOIN best b ON w.source = b.source AND w.node = b.node AND w.d = b.distance GROUP BY w.source, w.node, w.d)
SELECT q.question_id, 'What is the relation between word node ' || src || ' and word node ' || dst || '? Selected from the following candidate answers: ' || array_to_string(candidates, '; ') || '.' AS question,
  answer, 'test' AS split, CASE WHEN distance >= 1 THEN distance END AS true_hop, 'RelationPrediction' AS question_type, src AS source_node, dst AS target_node,
  array_to_string(coalesce(path, []), '>') AS shortest_path, distance AS structural_distance, distance IS NOT NULL AS structural_reachable,
  array_to_string(candidates, '|') AS candidate_relations, idx AS source_triple_index
FROM q JOIN cands USING (question_id) LEFT JOIN r ON r.source = src AND r.node = dst""")
def kg_questions(spark: SparkSession, sf: str) -> DataFrame:
    graph = P.adjacency(kg_small(spark, sf))
    q = Q.relation_questions(_held(spark, sf), graph, _vocab(spark, sf), "test", 32, 5)
    return q.withColumns({"shortest_path": F.array_join("shortest_path", ">"), "candidate_relations": F.array_join("candidate_relations", "|")})


#: Five line graphs of five nations each, one of them broken in two; questions on all pairs, some with a wrong label, type or name.
STATIONS = """nodes AS (SELECT n_nationkey // 5 AS graph_id, n_nationkey % 5 AS node_id, n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' has disabled access' ELSE ' does not have disabled access' END AS text, n_name AS name FROM nation),
asked AS (SELECT a.graph_id, a.graph_id || ':' || a.node_id || ':' || b.node_id AS question_id,
  CASE WHEN (a.node_id + b.node_id) % 7 = 6 THEN 'Where is ' || a.name || '?' ELSE 'How many stations are between ' || a.name || ' and ' || CASE WHEN b.node_id = 3 AND a.node_id = 0 THEN 'nowhere' ELSE b.name END || '?' END AS question,
  CASE WHEN a.node_id = 3 AND b.node_id = 1 THEN 'one' ELSE (greatest(abs(a.node_id - b.node_id) - 1, 0) + CASE WHEN a.node_id = 4 AND b.node_id = 1 THEN 1 ELSE 0 END)::VARCHAR END AS answer,
  CASE WHEN a.node_id = 4 AND b.node_id = 2 THEN 'StationShortestCount' WHEN b.node_id = a.node_id + 1 THEN '' END AS question_type,
  a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id)"""


def _stations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("n_nationkey").cast("long")
    access = F.when(key % 2 == 0, " has disabled access").otherwise(" does not have disabled access")
    nodes = table(spark, sf, "nation").select(F.floor(key / 5).alias("graph_id"), (key % 5).alias("node_id"), F.concat("n_name", access).alias("text"), F.col("n_name").alias("name"))
    a, b = (nodes.select("graph_id", F.col("node_id").alias(x), F.col("name").alias(f"name_{x}")) for x in "ab")
    p = a.join(b, "graph_id")
    to = F.when((F.col("b") == 3) & (F.col("a") == 0), "nowhere").otherwise(F.col("name_b"))
    question = F.when((F.col("a") + F.col("b")) % 7 == 6, F.format_string("Where is %s?", "name_a")).otherwise(F.format_string("How many stations are between %s and %s?", "name_a", to))
    wrong = F.when((F.col("a") == 4) & (F.col("b") == 1), 1).otherwise(0)
    at = lambda x, y: (F.col("a") == x) & (F.col("b") == y)
    answer = F.when(at(3, 1), "one").otherwise((F.greatest(F.abs(F.col("a") - F.col("b")) - 1, F.lit(0)) + wrong).cast("string"))
    kind = F.when(at(4, 2), Q.STATION_TYPE).when(F.col("b") == F.col("a") + 1, "").alias("question_type")
    asked = p.select("graph_id", F.concat_ws(":", "graph_id", "a", "b").alias("question_id"), question.alias("question"), answer.alias("answer"), kind)
    edges = nodes.filter("node_id < 4 and not (graph_id = 4 and node_id = 1)").select("graph_id", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    return asked, nodes.select("graph_id", "node_id", "text"), edges


@query(f"""WITH {STATIONS}, n AS (SELECT graph_id, node_id, CASE WHEN contains(text, ' does not have ') THEN split_part(text, ' does not have ', 1) ELSE split_part(text, ' has ', 1) END AS name FROM nodes),
p AS (SELECT *, regexp_matches(question, '(?is)How many stations are between\\s+(.+?)\\s+and\\s+(.+?)\\?') AS station,
  regexp_extract(question, '(?is)How many stations are between\\s+(.+?)\\s+and\\s+(.+?)\\?', 1) AS s, regexp_extract(question, '(?is)How many stations are between\\s+(.+?)\\s+and\\s+(.+?)\\?', 2) AS t FROM asked)
SELECT question_id, x.node_id AS source_node, y.node_id AS target_node,
  CASE WHEN NOT station AND coalesce(question_type, '') = '' THEN 'rejected_question_type' WHEN NOT station THEN 'rejected_question_does_not_match_StationShortestCount'
    WHEN x.node_id IS NULL OR y.node_id IS NULL THEN 'rejected_endpoint_extraction_ambiguous' WHEN x.node_id = y.node_id THEN 'rejected_source_and_target_must_be_distinct' END AS reason
FROM p LEFT JOIN n x ON x.graph_id = p.graph_id AND x.name = p.s AND station LEFT JOIN n y ON y.graph_id = p.graph_id AND y.name = p.t AND station""")
def station_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    asked, nodes, _ = _stations(spark, sf)
    return Q.station_questions(asked, nodes).select("question_id", "source_node", "target_node", "reason")


VALID = f"""WITH {STATIONS}, judged AS (SELECT *, CASE WHEN (a + b) % 7 = 6 AND coalesce(question_type, '') = '' THEN 'rejected_question_type' WHEN (a + b) % 7 = 6 THEN 'rejected_question_does_not_match_StationShortestCount'
  WHEN b = 3 AND a = 0 THEN 'rejected_endpoint_extraction_ambiguous' WHEN a = b THEN 'rejected_source_and_target_must_be_distinct'
  WHEN graph_id = 4 AND (a <= 1) <> (b <= 1) THEN 'rejected_endpoints_are_disconnected' WHEN answer = 'one' THEN 'rejected_answer_is_not_an_integer'
  WHEN a = 4 AND b = 1 THEN 'rejected_label/path_mismatch' END AS reason,
  CASE WHEN (a + b) % 7 = 6 OR (b = 3 AND a = 0) OR a = b OR (graph_id = 4 AND (a <= 1) <> (b <= 1)) THEN NULL ELSE abs(a - b) END::INT AS true_hop FROM asked)"""


@query(f"""{VALID} SELECT question_id, true_hop, reason,
  CASE WHEN reason IS NULL THEN array_to_string(CASE WHEN a < b THEN range(a, b + 1) ELSE list_reverse(range(b, a + 1)) END, '>') END AS shortest_path,
  CASE WHEN reason IS NULL THEN array_to_string([array_to_string([y FOR y IN range(5) IF abs(y - a) = d AND NOT (graph_id = 4 AND (y <= 1) <> (a <= 1))], ',') FOR d IN range(abs(a - b) + 1)], '|') END AS frontiers FROM judged""")
def path_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked, nodes, edges = _stations(spark, sf)
    q = Q.path_questions(asked, nodes, edges)
    path = F.array_join(F.transform("shortest_path", lambda p: p.cast("string")), ">")
    fronts = F.array_join(F.transform("frontiers", lambda f: F.array_join(F.transform(f, lambda n: n.cast("string")), ",")), "|")
    return q.select("question_id", "true_hop", "reason", path.alias("shortest_path"), fronts.alias("frontiers"))


def _hop_split_sql(rows: str, fraction: float = 0.2) -> str:
    return f"""placed AS (SELECT graph_id, question_id, true_hop, row_number() OVER (PARTITION BY graph_id, true_hop ORDER BY md5('2026:hop:' || graph_id || ':' || question_id), question_id) AS place FROM {rows} WHERE true_hop BETWEEN 1 AND 4),
capped AS (SELECT *, count(*) OVER (PARTITION BY graph_id, true_hop) AS n FROM placed WHERE place <= 32),
split AS (SELECT graph_id, question_id, true_hop, CASE WHEN true_hop >= 3 THEN 'test' WHEN place <= CASE WHEN n > 1 AND {fraction} > 0 THEN least(n - 1, greatest(1, round_even(n * {fraction}::DOUBLE, 0)::BIGINT)) ELSE 0 END THEN 'validation' ELSE 'train' END AS split FROM capped)"""


EVENT_HOPS = """hops AS (SELECT user_id % 40 AS graph_id, event_id AS question_id, (1 + try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INT) % 5)::INT AS true_hop FROM events)"""


def _event_hops(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", '"k": *(-?[0-9]+)', 1).try_cast("int")
    return table(spark, sf, "events").select((F.col("user_id") % 40).alias("graph_id"), F.col("event_id").alias("question_id"), (1 + k % 5).alias("true_hop"))


@query(f"WITH {EVENT_HOPS}, {_hop_split_sql('hops')} SELECT * FROM split")
def hop_split(spark: SparkSession, sf: str) -> DataFrame:
    return Q.hop_split(_event_hops(spark, sf))


@query(f"WITH {EVENT_HOPS}, {_hop_split_sql('hops', 0)} SELECT * FROM split")
def hop_split_without_validation(spark: SparkSession, sf: str) -> DataFrame:
    return Q.hop_split(_event_hops(spark, sf), fraction=0)


#: Counts by name; a hop of training questions has both names, if only with 0.
_COUNTS = """SELECT 'accepted_test_hop_' || true_hop AS name, count(*) AS n FROM split WHERE split = 'test' GROUP BY true_hop
UNION ALL SELECT 'accepted_' || s || '_hop_' || true_hop, sum((split = s)::BIGINT)::BIGINT FROM split, (SELECT unnest(['train', 'validation']) AS s) WHERE split <> 'test' GROUP BY s, true_hop"""


@query(f"""{VALID}, valid AS (SELECT graph_id, question_id, true_hop FROM judged WHERE reason IS NULL), {_hop_split_sql('valid')}
{_COUNTS} UNION ALL SELECT reason, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY reason""")
def split_rejections(spark: SparkSession, sf: str) -> DataFrame:
    q = Scratch(spark, "split").save(Q.path_questions(*_stations(spark, sf)), "questions")
    return Q.split_statistics(Q.hop_split(q.filter("reason is null")), q.filter("reason is not null"))


#: Graphs are users by 97; the hops of some of them are all beyond the range or all in training.
USER_HOPS = """uhops AS (SELECT user_id % 97 AS graph_id, event_id AS question_id, CASE WHEN user_id % 97 % 5 = 0 THEN 1 + event_id % 2 ELSE 1 + event_id % 6 END::INT AS true_hop FROM events)"""


@query(f"""WITH {USER_HOPS}, {_hop_split_sql('uhops')}, g AS (SELECT u.graph_id, coalesce(bool_or(s.split = 'train') AND bool_or(s.split = 'test'), false) AS ok FROM (SELECT DISTINCT graph_id FROM uhops) u LEFT JOIN split s ON s.graph_id = u.graph_id GROUP BY u.graph_id),
p AS (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), seen AS (SELECT * FROM p WHERE before < 16),
s2 AS (SELECT * FROM split WHERE graph_id IN (SELECT graph_id FROM seen WHERE ok)), out AS (SELECT * FROM uhops WHERE true_hop > 4 AND graph_id IN (SELECT graph_id FROM seen WHERE ok))
{_COUNTS.replace('FROM split', 'FROM s2')} UNION ALL SELECT 'rejected_hop_outside_requested_range', count(*) FROM out HAVING count(*) > 0
UNION ALL SELECT CASE WHEN ok THEN 'accepted_graphs' ELSE 'rejected_graph_missing_train_or_test' END, count(*) FROM seen GROUP BY ok""")
def dataset_split_stats(spark: SparkSession, sf: str) -> DataFrame:
    graph = F.col("user_id") % 97
    hop = F.when(graph % 5 == 0, 1 + F.col("event_id") % 2).otherwise(1 + F.col("event_id") % 6).cast("int")
    q = table(spark, sf, "events").select(graph.alias("graph_id"), F.col("event_id").alias("question_id"), hop.alias("true_hop"))
    return Q.dataset_statistics(q.select("graph_id").distinct(), Q.hop_split(q), Q.outside_hops(q))


@query(f"""WITH {EVENT_HOPS}, {_hop_split_sql('hops')}, good AS (SELECT graph_id FROM split GROUP BY graph_id HAVING bool_or(split = 'train') AND bool_or(split = 'test') ORDER BY graph_id LIMIT 16)
SELECT * FROM split WHERE graph_id IN (SELECT graph_id FROM good)""")
def graph_filter(spark: SparkSession, sf: str) -> DataFrame:
    return Q.graphs_with_both(Q.hop_split(_event_hops(spark, sf)))


@query("""WITH n AS (SELECT floor(0.2 * count(*))::BIGINT AS n FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('5:graphs:' || c_custkey), c_custkey) AS p FROM customer)
SELECT c_custkey, CASE WHEN p <= n THEN 'train' ELSE 'test' END AS split FROM r, n""")
def graph_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.share_split(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 0.2, 5, "graphs")


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'train' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'val' ELSE 'test' END AS split FROM customer""")
def route_split(spark: SparkSession, sf: str) -> DataFrame:
    ids = lambda s: table(spark, sf, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return Q.route_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", ids("F"), ids("O"))


@query(f"""WITH {KG_SMALL} SELECT idx, src, rel, dst, CASE rel WHEN 'lives_in' THEN 'train' WHEN 'located_in' THEN 'valid' ELSE 'test' END AS split FROM kg_small""")
def role_split(spark: SparkSession, sf: str) -> DataFrame:
    t = kg_small(spark, sf)
    return Q.union_splits({s: t.filter(F.col("rel") == r) for s, r in (("train", "lives_in"), ("valid", "located_in"), ("test", "part_of"))})


@query("""WITH g AS (SELECT l_orderkey AS graph_id, min(l_partkey) AS first, count(*) AS n, string_agg(l_partkey || ':' || l_returnflag, ',' ORDER BY l_partkey, l_returnflag) AS rows FROM lineitem GROUP BY l_orderkey)
SELECT graph_id, first, n, (sum(n) OVER (ORDER BY first, graph_id) - n)::BIGINT AS "offset", rows FROM g""")
def regroup_by_graph(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("graph_id"), "l_partkey", "l_returnflag")
    g = Q.regroup(li, ["l_returnflag"], "l_partkey")
    text = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["l_partkey"].cast("string"), r["l_returnflag"])), ",")
    return g.select("graph_id", "first", "n", "offset", text.alias("rows"))


@query("""SELECT c_custkey AS row_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN 'group-' || c_nationkey END) AS question_group FROM customer""")
def question_metadata(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    groups = F.when(k % 2 == 0, F.array(F.concat(F.lit("group-"), F.col("c_nationkey").cast("string"))))
    given = F.when(k % 3 == 0, F.array(F.struct(F.col("c_mktsegment").alias("group"))))
    return table(spark, sf, "customer").select(k.alias("row_id"), G.question_metadata(F.try_element_at(given, F.lit(1))["group"], F.try_element_at(groups, F.lit(1))).alias("question_group"))


@query("""SELECT p_partkey, trim(trim(CASE WHEN l || d = '' THEN 'missing' ELSE l || d END), '.') AS text
FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name || ', ' END AS l, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type || '.' END AS d FROM part)""")
def entity_text(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("p_size") % 3 != 0, F.col("p_name"))
    description = F.when(F.col("p_size") % 4 != 0, F.concat("p_type", F.lit(".")))
    return table(spark, sf, "part").select("p_partkey", X.entity_text(label, description).alias("text"))


@query(f"WITH {KG_SMALL}, {KG_MULTI}, {VOCAB} SELECT rel, array_to_string(list_slice(string_split(rel, '_'), 2, 99), ' ') AS text FROM vocab")
def relation_text(spark: SparkSession, sf: str) -> DataFrame:
    return _vocab(spark, sf).select("rel", X.relation_words(F.col("rel")).alias("text"))
