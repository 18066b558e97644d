"""Scans of triples, dictionaries, records, scenes and tables, with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import SPACE, object_text
from graphloom.plans import dense_index, dense_index_of_scan

from . import schemas


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").rlike(r"^[\s ]*$"))


#: A split of a file: splits are numbered by file name, and in a file by place.
_SPLIT = ["_file", "_block"]


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank with the split of a file that they are in."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return lines.filter(~F.col("value").rlike(r"^[\s ]*$"))


def read_triples(spark: SparkSession, path: str, lenient: bool = False, separator: str | None = None, drop_last: bool = False) -> DataFrame:
    """``idx, src, rel, dst`` of lines of three fields, numbered in line order; blank lines are skipped.

    Another number of fields is an error, or dropped if ``lenient``. ``drop_last`` leaves out the last line, as older
    scans did with a file that doesn't end in a line break.
    """
    rows = _split_lines(spark, path)
    if drop_last:
        rows = dense_index_of_scan(rows.withColumns({f"{c}_": F.col(c) for c in _SPLIT}), "_line", _SPLIT).withColumnsRenamed({f"{c}_": c for c in _SPLIT})
        rows = rows.join(F.broadcast(rows.agg(F.max("_line").alias("_last"))), F.col("_line") < F.col("_last"))
    trimmed = F.regexp_replace("value", r"^[\s ]+|[\s ]+$", "")
    kept = [*_SPLIT, *(["_line"] if drop_last else [])]
    # by way of explode a line is split once, not for each of its fields
    rows = rows.select("value", *kept, F.explode(F.array(F.split(trimmed, separator or SPACE))).alias("f"))
    bad = F.raise_error(F.concat(F.lit("not a triple: "), "value")).cast("array<string>")
    rows = rows.filter(F.size("f") == 3) if lenient else rows.withColumn("f", F.when(F.size("f") == 3, F.col("f")).otherwise(bad))
    triples = rows.select(*kept, F.col("f")[0].alias("src"), F.col("f")[1].alias("rel"), F.col("f")[2].alias("dst"))
    numbered = dense_index(triples, "idx", ["_line"]).drop("_line", *_SPLIT) if drop_last else dense_index_of_scan(triples, "idx", _SPLIT)
    return numbered.select("idx", "src", "rel", "dst")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """``pos, entity, label, description`` of a JSON map of entities; a folder may hold several maps, which follow each other
    by file name."""
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.from_json("value", schemas.ENTITIES).alias("m"))
    rows = doc.select("_file", F.explode("m").alias("entity", "v")).select("_file", "entity", "v.label", "v.description")
    return dense_index_of_scan(rows, "pos", ["_file"]).select("pos", "entity", "label", "description")


def read_entity_table(spark: SparkSession, path: str) -> DataFrame:
    """``entity, text`` of tab-separated lines."""
    parts = F.split("value", "\t", 2)
    return _lines(spark, path).select(parts[0].alias("entity"), F.get(parts, F.lit(1)).alias("text"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """``rel, text`` of a JSON map to texts or to objects with a label."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = doc.select(F.explode("m").alias("rel", "v"))
    return rows.select("rel", F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.label")).otherwise(F.col("v")).alias("text"))


def read_records(spark: SparkSession, path: str, schema: str = schemas.GRAPH_RECORD) -> DataFrame:
    """JSON lines; blank ones are skipped. Questions given as [text, [roots]] stay as JSON text, see ``split_question``."""
    return spark.read.schema(schema).json(path)


def split_question(df: DataFrame, column: str = "question") -> DataFrame:
    """``text`` and ``roots`` (null if absent) of questions that are a text or the JSON of [text, [roots]]."""
    q = F.col(column)
    listed = q.startswith("[")
    roots = F.from_json(F.get_json_object(q, "$[1]"), "array<long>")
    return df.withColumns({"text": F.when(listed, F.get_json_object(q, "$[0]")).otherwise(q), "roots": F.when(listed, roots)})


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_scenes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects ``image_id, object_id, text`` and relations ``image_id, object_id, rel, target_id`` of a scene file,
    or of a folder of them."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.SCENES).alias("m"))
    objects = doc.select(F.explode("m").alias("image_id", "i")).select("image_id", F.explode("i.objects").alias("object_id", "o"))
    o = lambda f: F.col(f"o.{f}")
    texts = objects.select("image_id", "object_id", object_text(o("name"), o("attributes"), o("x"), o("y"), o("w"), o("h")).alias("text"))
    relations = objects.select("image_id", "object_id", F.explode("o.relations").alias("r")).select("image_id", "object_id", F.col("r.name").alias("rel"), F.col("r.object").alias("target_id"))
    return texts, relations


def read_scene_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a CSV file; quotes within fields are doubled, and fields may go over several lines."""
    return spark.read.schema(schemas.SCENE_QUESTIONS).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


#: Splits of exported question sets and the names of their files.
EXPORTED_SPLITS = {"train": "train", "val": "validation", "test": "test"}


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """A question set exported as Parquet, one file or folder for each split: its columns with ``split``, and ``answer``
    as an array also where it is a single text."""
    out = None
    for split, name in EXPORTED_SPLITS.items():
        df = spark.read.parquet(f"{path}/{name}.parquet")
        if df.schema["answer"].dataType.simpleString() == "string":
            df = df.withColumn("answer", F.array("answer"))
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def exported_records(rows: DataFrame) -> DataFrame:
    """Graph records of an exported question set: a graph for each question, its triples ``graph`` without repeats and
    its nodes in order."""
    edges = F.array_distinct(F.col("graph"))
    nodes = F.array_sort(F.array_distinct(F.flatten(F.transform(edges, lambda e: F.array(e[0], e[2])))))
    rows = rows.withColumns({"_edges": edges, "_nodes": nodes})
    place = lambda x: F.array_position("_nodes", x) - 1
    graph = F.struct(F.col("_nodes").alias("node_list"), F.col("_edges").alias("edge_list"), F.transform("_edges", lambda e: F.array(place(e[0]), place(e[2]))).alias("edge_index"))
    return rows.select("split", F.col("id").cast("string").alias("id"), graph.alias("graph"), F.array("question").alias("questions"), F.array("answer").alias("answers"), F.array("q_entity").alias("q_entities"), F.array("a_entity").alias("a_entities"))


def concept_triples(lines: DataFrame) -> DataFrame:
    """Rows ``value`` of head, tail, relation that are all concepts, as ``src, rel, dst``."""
    f = F.split(F.btrim("value"), r"\s+")
    rows = lines.select(f.alias("f")).filter((F.size("f") >= 3) & F.col("f")[0].startswith("concept") & F.col("f")[1].startswith("concept") & F.col("f")[2].startswith("concept"))
    return rows.select(F.col("f")[0].alias("src"), F.col("f")[2].alias("rel"), F.col("f")[1].alias("dst"))


def concept_splits(train: DataFrame, dev: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples with ``split`` train, valid or test; distinct ``entity``) of three sets of concept lines."""
    parts = {"train": train, "valid": dev, "test": test}
    triples = None
    for name, lines in parts.items():
        df = concept_triples(lines).withColumn("split", F.lit(name))
        triples = df if triples is None else triples.unionByName(df)
    return triples, triples.select(F.explode(F.array("src", "dst")).alias("entity")).distinct()


def used_entries(dictionary: DataFrame, triples: DataFrame) -> DataFrame:
    """Entries of a dictionary that occur in triples."""
    ends = triples.select(F.explode(F.array("src", "dst")).alias("entity")).distinct()
    return dictionary.join(ends, "entity", "left_semi")


def require_entries(dictionary: DataFrame, triples: DataFrame) -> DataFrame:
    """``used_entries``; an error if an entity of the triples has no entry."""
    used = used_entries(dictionary, triples)
    n, there = triples.select(F.explode(F.array("src", "dst")).alias("entity")).distinct().count(), used.select("entity").distinct().count()
    if n != there:
        raise ValueError(f"{n} entities, {there} entries")
    return used


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


LOADERS: dict[str, Callable[..., DataFrame]] = {
    "triples": read_triples, "entities": read_entities, "entity_table": read_entity_table, "relations": read_relations,
    "records": read_records, "scene_questions": read_scene_questions, "exported": read_exported,
}


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Scan by registered name."""
    if kind not in LOADERS:
        raise ValueError(f"unknown source {kind}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[kind](spark, path, **options)
