"""Data sets by name: knowledge graphs from folders of raw files, scenes and question graphs.

A knowledge graph is tables of rows, not one record: nodes, edges, and questions of the splits. ``graph_record`` makes
the record of a graph where one is wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import graph as G
from graphloom.operators import questions as Q
from graphloom.operators.sample import sample_exactly
from graphloom.plans import dense_index, dense_index_by

from . import readers as R


@dataclass(frozen=True)
class KnowledgeGraph:
    """How a data set's files are read: the entities' file and text, the relations' text, the question's wording, how many
    candidates it has (None: all relations), and how many questions of a split are kept (None: all)."""

    entities: str
    entity_text: str
    relation_text: str
    relations: str | None = None
    node: str = "word node"
    candidates: int | None = Q.N_CANDIDATES
    limit: int | None = None


# The data sets, their files and wordings.
KNOWLEDGE_GRAPHS = {
    "codexm": KnowledgeGraph("entity2text.json", "described", "dictionary", "codexm.json"),
    "fb15k237": KnowledgeGraph("entity2wikidata.json", "described", "dictionary", "fb15k237.json"),
    "fb15k237_2": KnowledgeGraph("entity2wikidata.json", "described", "dictionary", "rel2text.json", node="node", limit=10_000),
    "nell23k": KnowledgeGraph("entity2text.json", "key", "name"),
    "wn18rr": KnowledgeGraph("entity2text.txt", "table", "words", candidates=None),
}
QUESTION_GRAPHS = ("cwq", "webqsp")
#: Names that the command line offers; the others are only there to be called.
REGISTERED = ("clegr", "codexm", "fb15k237_2", "nell23k", "scene_graph", "wn18rr")


def _entities(spark: SparkSession, kg: KnowledgeGraph, folder: str) -> DataFrame:
    path = f"{folder}/{kg.entities}"
    if kg.entity_text == "table":
        rows = R.read_entity_table(spark, path)
        return dense_index(rows.select("entity", "text"), "pos", ["entity"])
    rows = R.read_entities(spark, path)
    text = X.key_text(F.col("entity")) if kg.entity_text == "key" else X.entity_text(F.col("label"), F.col("description"))
    return rows.select("pos", "entity", text.alias("text"))


def _with_relation_text(spark: SparkSession, kg: KnowledgeGraph, folder: str, triples: DataFrame) -> DataFrame:
    if kg.relation_text == "dictionary":
        names = R.read_relations(spark, f"{folder}/{kg.relations}").withColumnRenamed("text", "_text")
        return triples.join(names, "rel").withColumn("rel", F.col("_text")).drop("_text")
    return triples.withColumn("rel", X.relation_words(F.col("rel"))) if kg.relation_text == "words" else triples


def load_knowledge_graph(spark: SparkSession, name: str, folder: str, seed: int = Q.SEED) -> dict[str, DataFrame]:
    """``nodes`` (node_id, entity, text), ``edges`` (idx, src_id, src, rel, dst_id, dst with texts) and ``questions`` (split
    val or test, idx, question, roots, answer) of a registered data set."""
    kg = KNOWLEDGE_GRAPHS[name]
    triples = {s: _with_relation_text(spark, kg, folder, R.read_triples(spark, f"{folder}/{s}.txt", lenient=True)) for s in ("train", "valid", "test")}
    entities = _entities(spark, kg, folder)
    every = triples["train"].withColumn("_s", F.lit(0)).unionByName(triples["valid"].withColumn("_s", F.lit(1))).unionByName(triples["test"].withColumn("_s", F.lit(2)))
    # unknown entities are numbered in order of first sight, training triples first
    sight = every.withColumn("idx", F.col("_s").cast("long") * (1 << 40) + F.col("idx")).drop("_s")
    ids = G.node_ids(entities.select("entity"), sight, entities.select("entity", "pos"))
    nodes = ids.join(entities.select("entity", "text"), "entity", "left").select("node_id", "entity", F.coalesce("text", F.lit(G.UNKNOWN)).alias("text"))
    vocab = G.relation_vocab(triples["train"])
    parts = []
    for split, source in (("val", "valid"), ("test", "test")):
        chosen = sample_exactly(triples[source], seed, split, ["idx"], kg.limit) if kg.limit else triples[source]
        asked = _named(chosen, nodes).select("idx", "src", "dst", F.col("rel").alias("answer"), F.array("src_id", "dst_id").alias("roots"), F.concat_ws(":", F.lit(name), F.lit(split), F.col("idx").cast("string")).alias("question_id"))
        n = kg.candidates or max(2, vocab.count())
        asked = Q.candidates(asked, vocab, n, seed)
        question = X.relation_question(F.col("src"), F.col("dst"), F.col("candidates"), kg.node)
        parts.append(asked.select(F.lit(split).alias("split"), "idx", question.alias("question"), "roots", "answer"))
    return {"nodes": nodes, "edges": _named(triples["train"], nodes), "questions": parts[0].unionAll(parts[1])}


def _named(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples with ids and texts of both ends."""
    end = lambda k: nodes.select(F.col("entity").alias(k), F.col("node_id").alias(f"{k}_id"), F.col("text").alias(f"_{k}"))
    rows = triples.join(end("src"), "src").join(end("dst"), "dst")
    return rows.select("idx", "src_id", F.col("_src").alias("src"), "rel", "dst_id", F.col("_dst").alias("dst"))


def graph_record(name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``title, id, graph`` in the record format: the whole graph in one value, as that format has it."""
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("v")))), lambda x: x["v"])
    a = nodes.agg(in_order("node_id", F.col("text")).alias("node_list"))
    b = edges.agg(in_order("idx", F.array("src", "rel", "dst")).alias("edge_list"), in_order("idx", F.array("src_id", "dst_id")).alias("edge_index"))
    return a.join(b).select(F.lit(name).alias("title"), F.lit("0").alias("id"), F.struct("node_list", "edge_list", "edge_index").alias("graph"))


def load_scenes(spark: SparkSession, folder: str, splits: DataFrame) -> DataFrame:
    """``image_id, split, title, graph, questions, answers, full_answers`` of scenes with questions. ``splits``: image_id
    and split; images without are test."""
    objects, relations = R.read_scenes(spark, f"{folder}/train_sceneGraphs.json")
    # numbered once, as a search in the scene for each end of an edge takes the square of its size
    objects = dense_index_by(objects, ["image_id"], "place", ["object_id"])
    end = lambda key, text, place: objects.select("image_id", F.col("object_id").alias(key), F.col("text").alias(text), F.col("place").alias(place))
    edges = relations.join(end("object_id", "src", "from"), ["image_id", "object_id"]).join(end("target_id", "dst", "to"), ["image_id", "target_id"])
    g = objects.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("object_id", "text"))).alias("o"))
    e = edges.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("object_id", "target_id", "src", "rel", "dst", "from", "to"))).alias("e"))
    none = F.array().cast("array<array<string>>")
    graph = F.struct(
        F.col("o.text").alias("node_list"), F.coalesce(F.transform("e", lambda x: F.array(x["src"], x["rel"], x["dst"])), none).alias("edge_list"),
        F.coalesce(F.transform("e", lambda x: F.array(x["from"], x["to"])), F.array().cast("array<array<bigint>>")).alias("edge_index"),
    )
    graphs = g.join(e, "image_id", "left").select("image_id", graph.alias("graph"))
    asked = R.read_scene_questions(spark, f"{folder}/questions.csv")
    lists = F.collect_list(F.struct("question", "answer", "full_answer"))
    asked = asked.groupBy("image_id").agg(F.array_sort(lists).alias("q"))
    rows = asked.join(graphs, "image_id").join(splits, "image_id", "left")
    title: Column = F.concat(F.lit("scene graph "), "image_id")
    return rows.select("image_id", F.coalesce("split", F.lit("test")).alias("split"), title.alias("title"), "graph", F.col("q.question").alias("questions"), F.col("q.answer").alias("answers"), F.col("q.full_answer").alias("full_answers"))


#: Columns of question rows that may be absent; a record has them only if they are there.
OPTIONAL_COLUMNS = {"question_type": "question_types", "question_group": "question_groups", "question_subgroup": "question_subgroups"}


def graph_questions(rows: DataFrame) -> DataFrame:
    """Graph records of question rows ``graph_id, idx, node_texts, edge_texts, edge_index, question, label``: a row for each
    graph, its questions in order of ``idx``. Optional columns are gathered if ``rows`` have them."""
    given = {c: n for c, n in OPTIONAL_COLUMNS.items() if c in rows.columns}
    lists = F.array_sort(F.collect_list(F.struct("idx", "question", "label", *given)))
    g = rows.groupBy("graph_id").agg(F.min_by(F.struct("node_texts", "edge_texts", "edge_index"), "idx").alias("g"), lists.alias("q"))
    text = lambda i: F.get(F.col("g.node_texts"), i.cast("int"))
    edges = F.zip_with("g.edge_index", "g.edge_texts", lambda e, t: F.array(text(e[0]), t, text(e[1])))
    graph = F.struct(F.col("g.node_texts").alias("node_list"), edges.alias("edge_list"), F.col("g.edge_index").alias("edge_index"))
    return g.select("graph_id", F.concat(F.lit("clegr graph "), F.col("graph_id").cast("string")).alias("title"), graph.alias("graph"), F.col("q.question").alias("questions"), F.col("q.label").alias("answers"), *[F.col(f"q.{c}").alias(n) for c, n in given.items()])


def load_dataset(spark: SparkSession, name: str, folder: str, **options):
    """A data set by name. ``scene_graph`` wants ``splits``; ``clegr`` reads question rows from Parquet, as its tensor
    files are out of scope."""
    if name in KNOWLEDGE_GRAPHS:
        return load_knowledge_graph(spark, name, folder, **options)
    if name == "scene_graph":
        return load_scenes(spark, folder, **options)
    if name == "clegr":
        return graph_questions(spark.read.parquet(folder))
    if name in QUESTION_GRAPHS:
        return R.exported_records(R.read_exported(spark, folder))
    known = sorted({*KNOWLEDGE_GRAPHS, *QUESTION_GRAPHS, *REGISTERED})
    raise ValueError(f"unknown data set {name}; known: {', '.join(known)}")
