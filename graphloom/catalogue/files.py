"""Queries that write a driver's table in a raw format and read it back through its scan."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import prepare as P
from graphloom.operators.analysis import accuracy_buckets
from graphloom.plans import Scratch, dense_index
from graphloom.sources import datasets as D
from graphloom.sources import readers as R
from graphloom.sources import schemas, sinks, table

from .questions import HELD, _held
from .registry import query
from .views import KG_SMALL, PRED_LOG, kg_small, pred_log


def _folder(spark: SparkSession, name: str) -> str:
    return f"{Scratch(spark, 'files').base}/{name}"


def _write_lines(df: DataFrame, path: str, order: str | None = None) -> str:
    """Writes ``value`` as lines; with ``order`` those of the files, by name, are in order."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    rows.select("value").write.mode("overwrite").text(path)
    return path


#: Entries of a JSON map that one file holds.
MAP_ENTRIES = 20_000


def _write_map(df: DataFrame, key: Column, value: Column, path: str, order: Column | None = None, entries: int = MAP_ENTRIES) -> str:
    """Writes ``df``'s rows as JSON maps of up to ``entries`` entries, a file for each, in order by name."""
    entry = F.to_json(F.create_map(key, value))
    rows = dense_index(df.select((key if order is None else order).alias("at"), F.substring(entry, F.lit(2), F.length(entry) - 2).alias("entry")), "n", ["at"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda e: e["entry"])
    docs = rows.groupBy(F.floor(F.col("n") / entries).alias("doc")).agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("value"))
    docs.repartitionByRange("doc").sortWithinPartitions("doc").select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


@query(f"WITH {KG_SMALL} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, src, rel, dst FROM kg_small")
def scan_triples(spark: SparkSession, sf: str) -> DataFrame:
    lines = kg_small(spark, sf).select("idx", F.concat_ws("\t", "src", "rel", "dst").alias("value"))
    return R.read_triples(spark, _write_lines(lines, _folder(spark, "train.txt"), "idx"))


@query(f"WITH {KG_SMALL} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, src, rel, dst FROM kg_small WHERE idx % 5 <> 0 AND idx < (SELECT max(idx) FROM kg_small)")
def scan_triples_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth line lacks its tail, and the last line is left out."""
    fields = F.array_compact(F.array("src", "rel", F.when(F.col("idx") % 5 != 0, F.col("dst"))))
    lines = kg_small(spark, sf).select("idx", F.concat(F.lit(" "), F.array_join(fields, "  ")).alias("value"))
    return R.read_triples(spark, _write_lines(lines, _folder(spark, "test.txt"), "idx"), lenient=True, drop_last=True)


@query(f"WITH {KG_SMALL} SELECT src, rel, dst FROM kg_small")
def sink_triples(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "export.txt")
    sinks.write_triples(kg_small(spark, sf), path)
    return R.read_triples(spark, path).drop("idx")


@query("""SELECT 'S' || s_suppkey AS entity, trim(trim(CASE WHEN l || d = '' THEN 'missing' ELSE l || d END), '.') AS text
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name || ', ' END AS l, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'of nation ' || s_nationkey || '.' END AS d FROM supplier)""")
def scan_entities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    described = F.struct(F.when(k % 3 != 0, F.col("s_name")).alias("label"), F.when(k % 4 != 0, F.concat(F.lit("of nation "), F.col("s_nationkey").cast("string"), F.lit("."))).alias("description"))
    path = _write_map(table(spark, sf, "supplier"), F.concat(F.lit("S"), k.cast("string")), described, _folder(spark, "entity2text.json"))
    return R.read_entities(spark, path).select("entity", X.entity_text(F.col("label"), F.col("description")).alias("text"))


@query("SELECT 'P' || p_partkey AS entity, p_name AS text FROM part")
def scan_entity_table(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("\t"), "p_name").alias("value"))
    return R.load(spark, "entity_table", _write_lines(lines, _folder(spark, "entity2text.txt")))


@query("SELECT 'r' || n_nationkey AS rel, n_name AS text FROM nation UNION ALL SELECT 'g' || r_regionkey, r_name FROM region")
def scan_relations(spark: SparkSession, sf: str) -> DataFrame:
    """One map of texts and one of objects with a label."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    plain = _write_map(table(spark, sf, "nation"), name("r", "n_nationkey"), F.col("n_name"), _folder(spark, "rel2text.json"))
    labelled = _write_map(table(spark, sf, "region"), name("g", "r_regionkey"), F.struct(F.col("r_name").alias("label")), _folder(spark, "relations.json"))
    return R.read_relations(spark, plain).unionAll(R.read_relations(spark, labelled))


@query("""SELECT 'g' || c_custkey AS id, c_name AS title, 'Who is ' || c_custkey || '?' AS question, CASE WHEN c_custkey % 2 = 0 THEN '0,' || c_nationkey END AS roots, c_mktsegment AS answer FROM customer""")
def scan_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records written in two goes, a part of their questions with root nodes."""
    k = F.col("c_custkey")
    q = F.concat(F.lit("Who is "), k.cast("string"), F.lit("?"))
    rooted = F.concat(F.lit('["'), q, F.lit('",[0,'), F.col("c_nationkey").cast("string"), F.lit("]]"))
    rows = table(spark, sf, "customer").select(F.concat(F.lit("g"), k.cast("string")).alias("id"), F.col("c_name").alias("title"), F.array(F.when(k % 2 == 0, rooted).otherwise(q)).alias("questions"), F.array("c_mktsegment").alias("answers"))
    path = _folder(spark, "processed_test.json")
    sinks.write_records(rows.filter("title is not null").filter(F.length("id") % 2 == 0), path)
    sinks.write_records(rows.filter("title is not null").filter(F.length("id") % 2 == 1), path, append=True)
    read = R.read_records(spark, path).select("id", "title", F.explode(F.arrays_zip("questions", "answers")).alias("qa"))
    split = R.split_question(read.select("id", "title", F.col("qa.questions").alias("question"), F.col("qa.answers").alias("answer")))
    return split.select("id", "title", F.col("text").alias("question"), F.array_join(F.transform("roots", lambda r: r.cast("string")), ",").alias("roots"), "answer")


@query("SELECT count(*) AS n, min(n_name) AS least FROM nation")
def scan_document(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document over several lines."""
    names = table(spark, sf, "nation").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    lines = names.select(F.concat(F.lit('{\n"context_samples":\n'), F.to_json("names"), F.lit("\n}")).alias("value"))
    doc = R.read_document(spark, _write_lines(lines, _folder(spark, "tasks.json")), schemas.TASK_SET)
    return doc.select(F.explode("context_samples").alias("t")).agg(F.count("*").alias("n"), F.min("t").alias("least"))


#: Scenes are customers of a nation; each is left of the next one of its scene.
SCENES = """sc AS (SELECT c_nationkey::VARCHAR AS image_id, 'o' || c_custkey AS object_id, c_custkey AS k, lead('o' || c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS target_id FROM customer),
tx AS (SELECT image_id, object_id, target_id, trim(CASE WHEN k % 2 = 0 THEN 'red, old' ELSE '' END || ' thing ' || k || ' at coordinate (' || k % 50 || ', 2) with width 3 and height ' || k % 7) AS text FROM sc)"""


def _write_scenes(spark: SparkSession, sf: str, folder: str) -> None:
    from pyspark.sql import Window as W

    k, place = F.col("c_custkey"), W.partitionBy("c_nationkey").orderBy("c_custkey")
    name = F.concat(F.lit("o"), k.cast("string"))
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", name.alias("object_id"), F.lead(name).over(place).alias("next"))
    related = F.when(F.col("next").isNotNull(), F.array(F.struct(F.lit("left of").alias("name"), F.col("next").alias("object")))).otherwise(F.array().cast("array<struct<name:string,object:string>>"))
    thing = F.struct(
        F.concat(F.lit("thing "), k.cast("string")).alias("name"), (k % 50).cast("int").alias("x"), F.lit(2).alias("y"), F.lit(3).alias("w"), (k % 7).cast("int").alias("h"),
        F.when(k % 2 == 0, F.array(F.lit("red"), F.lit("old"))).otherwise(F.array().cast("array<string>")).alias("attributes"), related.alias("relations"),
    )
    scenes = rows.groupBy("c_nationkey").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("object_id", thing))).alias("objects")).alias("v"))
    _write_map(scenes, F.col("c_nationkey").cast("string"), F.col("v"), f"{folder}/train_sceneGraphs.json", entries=1)


@query(f"WITH {SCENES} SELECT a.image_id, a.object_id, a.text, 'left of' AS rel, a.target_id, b.text AS target FROM tx a JOIN tx b ON a.image_id = b.image_id AND a.target_id = b.object_id")
def scan_scenes(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark, "scenes")
    _write_scenes(spark, sf, folder)
    objects, relations = R.read_scenes(spark, f"{folder}/train_sceneGraphs.json")
    target = objects.select("image_id", F.col("object_id").alias("target_id"), F.col("text").alias("target"))
    return objects.join(relations, ["image_id", "object_id"]).join(target, ["image_id", "target_id"]).select("image_id", "object_id", "text", "rel", "target_id", "target")


@query("SELECT n_nationkey::VARCHAR AS image_id, 'Is it \"' || n_name || '\", yes?' AS question, n_name AS answer, 'It is ' || n_name || '.' AS full_answer FROM nation")
def scan_scene_questions(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "questions.csv")
    _scene_questions(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return R.read_scene_questions(spark, path)


def _scene_questions(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("image_id"), F.concat(F.lit('Is it "'), name, F.lit('", yes?')).alias("question"), name.alias("answer"), F.concat(F.lit("It is "), name, F.lit(".")).alias("full_answer")
    )


@query(f"""WITH {SCENES}, n AS (SELECT image_id, count(*) AS n_nodes, count(target_id) AS n_edges FROM tx GROUP BY image_id)
SELECT n.image_id, CASE WHEN n_nationkey < 5 THEN 'train' WHEN n_nationkey < 8 THEN 'val' ELSE 'test' END AS split, 'scene graph ' || n.image_id AS title, n_nodes, n_edges, 'Is it "' || n_name || '", yes?' AS question, n_name AS answer
FROM n JOIN nation ON n.image_id = n_nationkey::VARCHAR""")
def dataset_scene_graph(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark, "scene_graph")
    _write_scenes(spark, sf, folder)
    _scene_questions(spark, sf).write.option("header", True).option("escape", '"').csv(f"{folder}/questions.csv")
    k = F.col("n_nationkey")
    splits = table(spark, sf, "nation").filter("n_nationkey < 8").select(k.cast("string").alias("image_id"), F.when(k < 5, "train").otherwise("val").alias("split"))
    rows = D.load_dataset(spark, "scene_graph", folder, splits=splits)
    sizes = [F.size(f"graph.{c}").cast("long").alias(n) for c, n in (("node_list", "n_nodes"), ("edge_index", "n_edges"))]
    return rows.select("image_id", "split", "title", *sizes, F.col("questions")[0].alias("question"), F.col("answers")[0].alias("answer"))


@query("""WITH q AS (SELECT c_custkey AS id, 'Where is ' || c_custkey || '?' AS question, c_nationkey AS n, c_custkey % 3 AS s FROM customer)
SELECT CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, id::VARCHAR AS id, question, 'nation ' || n AS answer, 'C' || id || '|' || 'N' || n AS nodes, '0,1' AS edge FROM q""")
def dataset_question_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Exported question sets: a graph with a repeated triple for each question."""
    return _question_graphs(spark, sf, "cwq")


def _question_graphs(spark: SparkSession, sf: str, data_set: str) -> DataFrame:
    folder, k, n = _folder(spark, data_set), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    edge = F.array(F.concat(F.lit("C"), k), F.lit("in"), F.concat(F.lit("N"), n))
    for i, name in enumerate(R.EXPORTED_SPLITS.values()):
        answer = F.concat(F.lit("nation "), n)
        rows = table(spark, sf, "customer").filter(F.col("c_custkey") % 3 == i).select(
            F.col("c_custkey").alias("id"), F.concat(F.lit("Where is "), k, F.lit("?")).alias("question"), (F.array(answer) if i else answer).alias("answer"),
            F.array(edge, edge).alias("graph"), F.array(k).alias("q_entity"), F.array(n).alias("a_entity"),
        )
        rows.write.parquet(f"{folder}/{name}.parquet")
    r = D.load_dataset(spark, data_set, folder)
    places = F.array_join(F.transform(F.col("graph.edge_index")[0], lambda i: i.cast("string")), ",")
    return r.select("split", "id", F.col("questions")[0].alias("question"), F.col("answers")[0][0].alias("answer"), F.array_join("graph.node_list", "|").alias("nodes"), places.alias("edge"))


@query("""SELECT CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT c_nationkey) AS n_answers FROM customer GROUP BY 1""")
def dataset_webqsp(spark: SparkSession, sf: str) -> DataFrame:
    return _question_graphs(spark, sf, "webqsp").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("answer").alias("n_answers"))


@query("SELECT 'concept:c' || c_custkey AS src, 'concept:lives' AS rel, 'concept:n' || c_nationkey AS dst, CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM customer WHERE c_custkey % 7 <> 0")
def concept_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _concepts(spark, sf)[0]


def _concepts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Heads of every seventh line are no concepts."""
    k = F.col("c_custkey")
    head = F.concat(F.when(k % 7 == 0, "thing:c").otherwise("concept:c"), k.cast("string"))
    lines = table(spark, sf, "customer").select(k, F.concat_ws("\t", head, F.concat(F.lit("concept:n"), F.col("c_nationkey").cast("string")), F.lit("concept:lives")).alias("value"))
    return R.concept_splits(*[lines.filter(k % 3 == i).select("value") for i in range(3)])


@query("SELECT DISTINCT 'concept:c' || c_custkey AS entity FROM customer WHERE c_custkey % 7 <> 0 UNION SELECT 'concept:n' || c_nationkey FROM customer WHERE c_custkey % 7 <> 0")
def concept_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _concepts(spark, sf)[1]


@query(f"WITH {KG_SMALL}, d AS (SELECT 'N' || n_nationkey AS entity, n_name AS text FROM nation UNION ALL SELECT 'P' || p_partkey, p_name FROM part UNION ALL SELECT 'R' || r_regionkey, r_name FROM region) SELECT entity, text FROM d WHERE entity IN (SELECT src FROM kg_small UNION SELECT dst FROM kg_small)")
def used_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary of nations, regions and parts, of which the triples have no part."""
    named = lambda t, prefix, key, text: table(spark, sf, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity"), F.col(text).alias("text"))
    entries = named("nation", "N", "n_nationkey", "n_name").unionAll(named("part", "P", "p_partkey", "p_name")).unionAll(named("region", "R", "r_regionkey", "r_name"))
    return R.used_entries(entries, kg_small(spark, sf))


@query(f"""WITH {KG_SMALL}, ids AS (SELECT e, row_number() OVER (ORDER BY seen) - 1 AS id FROM (SELECT e, min("at") AS seen FROM (SELECT 'C' || c_custkey AS e, c_custkey AS "at" FROM customer
  UNION ALL SELECT src, 1000000000000 + 2 * idx FROM kg_small UNION ALL SELECT dst, 1000000000001 + 2 * idx FROM kg_small) AS u GROUP BY e) AS v)
SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, a.id AS src_id, CASE WHEN src LIKE 'C%' THEN src ELSE 'Unknown' END AS src, rel, b.id AS dst_id, 'Unknown' AS dst FROM kg_small JOIN ids a ON a.e = src JOIN ids b ON b.e = dst""")
def dataset_knowledge_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of raw files whose dictionary has only the customers."""
    folder, k = _folder(spark, "nell23k"), F.col("c_custkey")
    lines = kg_small(spark, sf).select("idx", F.concat_ws("\t", "src", "rel", "dst").alias("value"))
    for name in ("train", "valid", "test"):
        _write_lines(lines, f"{folder}/{name}.txt", "idx")
    _write_map(table(spark, sf, "customer"), F.concat(F.lit("C"), k.cast("string")), F.struct(F.lit("x").alias("label")), f"{folder}/entity2text.json", k)
    return D.load_dataset(spark, "nell23k", folder)["edges"]


#: Order lines that one file of triples holds.
ROWS_PER_FILE = 500_000
#: Two triples of every order line; parts have entries, some of them empty ones, suppliers and orders don't.
_LINES = """ln AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS n, l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem),
tr AS (SELECT 2 * n AS idx, 'O' || l_orderkey AS src, 'has_part_' || lower(l_returnflag) AS rel, 'P' || l_partkey AS dst FROM ln UNION ALL SELECT 2 * n + 1, 'P' || l_partkey, 'sold_by', 'S' || l_suppkey FROM ln),
first AS (SELECT e, min("at") AS seen FROM (SELECT src AS e, 2 * idx AS "at" FROM tr UNION ALL SELECT dst, 2 * idx + 1 FROM tr) AS u GROUP BY e)"""


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]


def _line_relations() -> tuple[Column, Column]:
    return F.concat(F.lit("has_part_"), F.lower("l_returnflag")), F.lit("sold_by")


def _triple_lines(rows: DataFrame) -> DataFrame:
    """Both lines of an order line as one ``value``."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    has, sold = _line_relations()
    first = F.concat_ws("\t", name("O", "l_orderkey"), has, name("P", "l_partkey"))
    return rows.select(F.concat_ws("\n", first, F.concat_ws("\t", name("P", "l_partkey"), sold, name("S", "l_suppkey"))).alias("value"))


def _write_triples(spark: SparkSession, sf: str, folder: str) -> None:
    """The same lines as files of the three splits. Order lines are sorted once; those of a task go to files in order by name."""
    rows = table(spark, sf, "lineitem").select(*_LINE).repartitionByRange(*_LINE).sortWithinPartitions(*_LINE).persist(StorageLevel.DISK_ONLY)
    try:
        for split in ("train", "valid", "test"):
            # each file of gzip is read by one task, so a task writes several
            _triple_lines(rows).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "gzip").text(f"{folder}/{split}.txt")
    finally:
        rows.unpersist()


def _knowledge_graph(spark: SparkSession, sf: str, name: str) -> dict[str, DataFrame]:
    """Loads a data set by name from a folder of raw files in its formats."""
    folder, kg, k = _folder(spark, name), D.KNOWLEDGE_GRAPHS[name], F.col("p_partkey")
    _write_triples(spark, sf, folder)
    parts = table(spark, sf, "part")
    if kg.entity_text == "table":
        _write_lines(parts.select(F.concat(F.lit("P"), k.cast("string"), F.lit("\t"), "p_name").alias("value")), f"{folder}/{kg.entities}")
    else:
        described = F.struct(F.when(k % 3 != 0, F.col("p_name")).alias("label"), F.when(k % 4 != 0, F.col("p_brand")).alias("description"))
        _write_map(parts, F.concat(F.lit("P"), k.cast("string")), described, f"{folder}/{kg.entities}")
    if kg.relations:
        rels = table(spark, sf, "lineitem").select(F.explode(F.array(*_line_relations())).alias("rel")).distinct()
        _write_map(rels, F.col("rel"), F.concat(F.lit("text of "), "rel"), f"{folder}/{kg.relations}")
    return D.load_dataset(spark, name, folder)


def _edges_sql(text: str, rel: str) -> str:
    """SQL of the edges' texts, with ``text`` of part entries and ``rel`` of relations."""
    return f"""WITH {_LINES}, tx AS (SELECT 'P' || p_partkey AS e, {text} AS t FROM part)
SELECT idx, coalesce(a.t, 'Unknown') AS src, {rel} AS rel, coalesce(b.t, 'Unknown') AS dst FROM tr LEFT JOIN tx a ON a.e = src LEFT JOIN tx b ON b.e = dst"""


_DESCRIBED = "trim(trim(CASE WHEN p_partkey % 12 = 0 THEN 'missing' ELSE CASE WHEN p_partkey % 3 <> 0 THEN p_name || ', ' ELSE '' END || CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE '' END END), '.')"


@query(_edges_sql(_DESCRIBED, "'text of ' || rel"))
def dataset_codexm(spark: SparkSession, sf: str) -> DataFrame:
    return _knowledge_graph(spark, sf, "codexm")["edges"].select("idx", "src", "rel", "dst")


@query(_edges_sql(_DESCRIBED, "'text of ' || rel"))
def dataset_fb15k237(spark: SparkSession, sf: str) -> DataFrame:
    return _knowledge_graph(spark, sf, "fb15k237")["edges"].select("idx", "src", "rel", "dst")


@query(f"""WITH {_LINES}, tx AS (SELECT 'P' || p_partkey AS e, {_DESCRIBED} AS t FROM part),
q AS (SELECT split, idx, src, rel, dst FROM tr, (SELECT unnest(['val', 'test']) AS split) QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5('2026:' || split || ':' || idx), idx) <= 10000),
v AS (SELECT DISTINCT 'text of ' || rel AS rel FROM tr),
c AS (SELECT split, idx, string_agg(v.rel, '; ' ORDER BY md5('2026:cand-order:fb15k237_2:' || split || ':' || idx || ':' || v.rel), v.rel) AS t FROM q, v GROUP BY split, idx)
SELECT q.split, q.idx, 'What is the relation between node ' || coalesce(a.t, 'Unknown') || ' and node ' || coalesce(b.t, 'Unknown') || '? Selected from the following candidate answers: ' || c.t || '.' AS question, 'text of ' || rel AS answer
FROM q JOIN c ON c.split = q.split AND c.idx = q.idx LEFT JOIN tx a ON a.e = src LEFT JOIN tx b ON b.e = dst""")
def dataset_fb15k237_2(spark: SparkSession, sf: str) -> DataFrame:
    """10,000 questions of each split."""
    return _knowledge_graph(spark, sf, "fb15k237_2")["questions"].drop("roots")


@query(_edges_sql("p_name", "array_to_string(string_split(rel, '_')[2:], ' ')"))
def dataset_wn18rr(spark: SparkSession, sf: str) -> DataFrame:
    return _knowledge_graph(spark, sf, "wn18rr")["edges"].select("idx", "src", "rel", "dst")


@query("""SELECT 'clegr graph ' || o_custkey AS title, count(*) AS n_questions, string_agg(o_orderkey || '=' || o_orderstatus, '|' ORDER BY o_orderkey) AS asked FROM orders GROUP BY o_custkey""")
def dataset_graph_questions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("graph_id"), k.alias("idx"), F.array(F.lit("a"), F.lit("b")).alias("node_texts"), F.array(F.lit("r")).alias("edge_texts"),
        F.array(F.array(F.lit(0), F.lit(1))).alias("edge_index"), k.cast("string").alias("question"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("question_type"),
    )
    path = _folder(spark, "clegr")
    rows.write.parquet(path)
    g = D.load_dataset(spark, "clegr", path)
    asked = F.array_join(F.zip_with("questions", "answers", lambda q, a: F.concat(q, F.lit("="), a)), "|")
    return g.select("title", F.size("question_types").cast("long").alias("n_questions"), asked.alias("asked"))


@query(f"""WITH {PRED_LOG}, d AS (SELECT *, coalesce(adapter_control, 'correct') AS c, coalesce(split, 'unknown') AS s FROM pred_log),
r AS (SELECT 'hop' AS family, 'hop=' || true_hop || '|k=' || recurrence_k || '|adapter=' || c AS bucket, correct FROM d WHERE true_hop >= 1
  UNION ALL SELECT 'k', 'k=' || recurrence_k || '|adapter=' || c, correct FROM d UNION ALL SELECT 'split', 'split=' || s || '|k=' || recurrence_k || '|adapter=' || c, correct FROM d)
SELECT family, bucket, count(*) AS count, round(avg(correct::INT), 9) AS accuracy FROM r GROUP BY family, bucket""")
def sink_buckets(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "buckets")
    sinks.write_buckets(accuracy_buckets(pred_log(spark, sf)), path)
    return spark.read.schema("bucket string, count long, accuracy double, family string").option("header", True).csv(path).select("family", "bucket", "count", F.round("accuracy", 9).alias("accuracy"))


@query("SELECT count(*) AS n, sum(c_acctbal)::DECIMAL(18,2)::VARCHAR AS total FROM customer")
def sink_stats(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "customers")
    sinks.write_stats(table(spark, sf, "customer").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(18,2)").cast("string").alias("total")), path)
    return spark.read.schema("n long, total string").json(f"{path}.stats.json")


@query("SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation")
def file_digest(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    path = _write_lines(lines.repartition(1).sortWithinPartitions("n_nationkey"), _folder(spark, "names.txt"))
    return R.file_digest(spark, f"{path}/part-*").select("sha256")


@query(f"""WITH {KG_SMALL}, {HELD}, t AS (SELECT 'train' AS split, idx, src, dst FROM kg_small UNION ALL SELECT 'validation', idx, src, dst FROM held UNION ALL SELECT 'test', idx, src, dst FROM held),
s AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5('2026:' || split || ':' || idx), idx) <= CASE split WHEN 'validation' THEN 32 ELSE 64 END)
SELECT t.split, count(*) AS available, (SELECT count(*) FROM s WHERE s.split = t.split) AS selected, (SELECT count(*) FROM s JOIN customer ON c_custkey = idx JOIN nation ON n_nationkey = c_nationkey WHERE s.split = t.split AND s.split <> 'train' AND dst <> 'R' || n_regionkey) AS unreachable FROM t GROUP BY t.split""")
def prepared_stats(spark: SparkSession, sf: str) -> DataFrame:
    train, held = kg_small(spark, sf), _held(spark, sf)
    names = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity"))
    path = _folder(spark, "prepared")
    p = P.prepare_questions(train, held, held, names, "kg", n_candidates=3)
    P.write_prepared(p, path, "kg")
    back = spark.read.json(f"{path}/questions").groupBy("split").agg(F.count("*").alias("selected"), F.count(F.when(~F.col("structural_reachable"), 1)).alias("unreachable"))
    return p["stats"].select("split", "available").join(back, "split")
