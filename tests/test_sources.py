import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.analysis import accuracy_buckets
from graphloom.sources import readers as R
from graphloom.sources import datasets, schemas, sinks
from graphloom.streaming import bucket_counts, read_log


def test_triples(spark, tmp_path):
    p = tmp_path / "train.txt"
    p.write_text("a r1 b\n\n  b\tr2  c \nc r3 d")
    rows = [(r.idx, r.src, r.rel, r.dst) for r in R.read_triples(spark, str(p)).orderBy("idx").collect()]
    assert rows == [(0, "a", "r1", "b"), (1, "b", "r2", "c"), (2, "c", "r3", "d")]
    p.write_text("a r1 b\nonly two\n")
    assert R.read_triples(spark, str(p), lenient=True).count() == 1
    with pytest.raises(Exception, match="not a triple"):
        R.read_triples(spark, str(p)).collect()


def test_dictionaries_and_records(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"a": {"label": "A", "description": "first"}, "b": {"label": "B"}, "c": {}}))
    e = R.read_entities(spark, str(tmp_path / "e.json"))
    texts = {r.entity: r.t for r in e.select("entity", X.entity_text(e.label, e.description).alias("t")).collect()}
    assert texts == {"a": "A, first", "b": "B,", "c": "missing"}
    (tmp_path / "r.json").write_text(json.dumps({"r1": "one", "r2": {"label": "two"}}))
    assert {r.rel: r.text for r in R.read_relations(spark, str(tmp_path / "r.json")).collect()} == {"r1": "one", "r2": "two"}
    (tmp_path / "w.txt").write_text("01\tfirst thing\n02\tsecond\n")
    assert R.load(spark, "entity_table", str(tmp_path / "w.txt")).count() == 2
    record = {"id": "g", "title": "t", "graph": {"node_list": ["x"], "edge_list": [], "edge_index": []}, "questions": ["plain", ["rooted", [1, 2]]], "answers": ["1", "2"]}
    (tmp_path / "g.jsonl").write_text(json.dumps(record) + "\n\n")
    q = R.read_records(spark, str(tmp_path / "g.jsonl")).selectExpr("explode(questions) as question")
    assert [(r.text, r.roots) for r in R.split_question(q).collect()] == [("plain", None), ("rooted", [1, 2])]


def test_scenes(spark, tmp_path):
    scene = {"1": {"objects": {"7": {"name": "cup", "x": 1, "y": 2, "w": 3, "h": 4, "attributes": ["red", "old"], "relations": [{"name": "on", "object": "8"}]},
                               "8": {"name": "table", "x": 0, "y": 0, "w": 9, "h": 9, "attributes": [], "relations": []}}}}
    (tmp_path / "s.json").write_text(json.dumps(scene))
    objects, relations = R.read_scenes(spark, str(tmp_path / "s.json"))
    assert {r.text for r in objects.collect()} == {"red, old cup at coordinate (1, 2) with width 3 and height 4", "table at coordinate (0, 0) with width 9 and height 9"}
    assert [(r.object_id, r.rel, r.target_id) for r in relations.collect()] == [("7", "on", "8")]


def test_concepts_and_digest(spark, tmp_path):
    lines = spark.createDataFrame([("concept:a concept:b concept:r",), ("x concept:b concept:r",)], "value string")
    assert [tuple(r) for r in R.concept_triples(lines).collect()] == [("concept:a", "concept:r", "concept:b")]
    (tmp_path / "f").write_bytes(b"abc")
    assert R.file_digest(spark, str(tmp_path / "f")).first().sha256.startswith("ba7816bf")


def test_sinks_and_stream(spark, tmp_path):
    log = spark.createDataFrame([("q", 1, 1, None, True, None, 0), ("q", 1, 2, None, False, None, 1)], "question_id string, true_hop int, recurrence_k int, adapter_control string, correct boolean, split string, pos long")
    sinks.write_buckets(accuracy_buckets(log), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 6
    sinks.write_records(log, str(tmp_path / "log"))
    sinks.write_records(log, str(tmp_path / "log"), append=True)
    stream = bucket_counts(read_log(spark, str(tmp_path / "log"), "question_id string, recurrence_k int, adapter_control string, correct boolean"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.recurrence_k, r.n, r.accuracy) for r in spark.table("buckets").collect()} == {(1, 2, 1.0), (2, 2, 0.0)}
    assert schemas.PREDICTION


def test_lines_of_several_files_and_a_lost_last_line(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        (tmp_path / "d" / f"part-{k}").write_text("".join(f"a{k}{i} r b\n" for i in range(4 + 5 * (k == 0))))
    rows = [(r.idx, r.src) for r in R.read_triples(spark, str(tmp_path / "d")).orderBy("idx").collect()]
    assert [s for _, s in rows] == sorted(s for _, s in rows) and [i for i, _ in rows] == list(range(17))
    (tmp_path / "t.txt").write_text("a r b\nc r d\ne r f")
    assert [r.src for r in R.read_triples(spark, str(tmp_path / "t.txt"), drop_last=True).orderBy("idx").collect()] == ["a", "c"]


def test_entries(spark):
    triples = spark.createDataFrame([(0, "a", "r", "b")], "idx long, src string, rel string, dst string")
    entries = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    assert R.require_entries(entries, triples).count() == 2
    with pytest.raises(ValueError, match="2 entities, 1 entries"):
        R.require_entries(entries.filter("entity <> 'b'"), triples)


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="unknown data set"):
        datasets.load_dataset(spark, "other", "x")
    with pytest.raises(ValueError, match="unknown source"):
        R.load(spark, "other", "x")


def test_graph_record(spark):
    nodes = spark.createDataFrame([(1, "b", "B"), (0, "a", "A")], "node_id long, entity string, text string")
    edges = spark.createDataFrame([(0, 0, "A", "r", 1, "B")], "idx long, src_id long, src string, rel string, dst_id long, dst string")
    r = datasets.graph_record("t", nodes, edges).first()
    assert (r.title, r.graph.node_list, r.graph.edge_list, r.graph.edge_index) == ("t", ["A", "B"], [["A", "r", "B"]], [[0, 1]])


def test_tables_without_a_shared_folder():
    """In a process of its own, as its session has no spark.checkpoint.dir."""
    code = (
        "from pyspark.sql import SparkSession; from graphloom.plans import Scratch, clear\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert Scratch(s, 'x').save(s.range(3), 'a').count() == 3; clear(s); print('fine')"
    )
    env = dict(os.environ, SPARK_CONF_DIR="/nonexistent")
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr[-2000:]


def test_maps_in_several_files_are_numbered_through(spark, tmp_path):
    from graphloom.catalogue import files

    entries = spark.range(50).selectExpr("id", "concat('e', id) AS name")
    path = files._write_map(entries, F.col("name"), F.struct(F.col("name").alias("label")), str(tmp_path / "map"), F.col("id"), entries=7)
    assert len(list((tmp_path / "map").glob("part-*"))) == 8
    rows = sorted((r.pos, r.entity, r.label) for r in R.read_entities(spark, path).collect())
    assert rows == [(i, f"e{i}", f"e{i}") for i in range(50)]


def test_lines_are_written_by_many_tasks_and_numbered_without_a_sort(spark, tmp_path):
    from graphloom.catalogue import files

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = spark.range(1000).selectExpr("999 - id AS idx", "concat('a', 999 - id, ' r b') AS value")
        path = files._write_lines(lines, str(tmp_path / "lines"), "idx")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "lines").glob("part-*"))) > 1
    for options, n in (({}, 1000), ({"lenient": True}, 1000), ({"lenient": True, "drop_last": True}, 999)):
        read = R.read_triples(spark, path, **options)
        assert sorted((r.idx, r.src) for r in read.collect()) == [(i, f"a{i}") for i in range(n)]
    assert "rangepartitioning" not in R.read_triples(spark, path)._jdf.queryExecution().toString()


def test_places_in_a_scene_are_joined_not_searched(spark, tmp_path):
    from graphloom.sources import datasets as D

    spark.createDataFrame([('{"1":{"objects":{"b":{"name":"b","x":1,"y":1,"w":1,"h":1,"attributes":[],"relations":[{"name":"on","object":"a"}]},"a":{"name":"a","x":1,"y":1,"w":1,"h":1,"attributes":[],"relations":[]}}}}',)], "value string").coalesce(1).write.text(str(tmp_path / "train_sceneGraphs.json"))
    spark.createDataFrame([("1", "q", "a", "f")], "image_id string, question string, answer string, full_answer string").write.option("header", True).csv(str(tmp_path / "questions.csv"))
    rows = D.load_scenes(spark, str(tmp_path), spark.createDataFrame([], "image_id string, split string"))
    assert [r.graph.edge_index for r in rows.collect()] == [[[1, 0]]]
    assert "array_position" not in rows._jdf.queryExecution().toString()


def test_triples_of_many_packed_files_are_numbered_in_order(spark, tmp_path, monkeypatch):
    from graphloom.catalogue import files

    rows = spark.range(3000).selectExpr("2999 - id AS l_orderkey", "1 AS l_linenumber", "id % 7 AS l_partkey", "id % 3 AS l_suppkey", "'R' AS l_returnflag")
    rows.write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    monkeypatch.setattr(files, "ROWS_PER_FILE", 200)
    files._write_triples(spark, str(tmp_path / "sf"), str(tmp_path / "kg"))
    for split in ("train", "valid", "test"):
        packed = list((tmp_path / "kg" / f"{split}.txt").glob("part-*.gz"))
        assert len(packed) >= 15
        read = R.read_triples(spark, str(tmp_path / "kg" / f"{split}.txt"), lenient=True)
        found = sorted((r.idx, r.src, r.rel, r.dst) for r in read.collect())
        made = [(f"O{k}", "has_part_r", f"P{(2999 - k) % 7}", f"P{(2999 - k) % 7}", "sold_by", f"S{(2999 - k) % 3}") for k in range(3000)]
        assert found == [(2 * k + i, *m[3 * i : 3 * i + 3]) for k, m in enumerate(made) for i in (0, 1)]
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_numbered_lines_take_little_scratch(spark, tmp_path):
    """Names that count up and places in the scan are stored by their differences."""
    from graphloom.plans.scratch import shared_root

    lines = spark.range(0, 200_000, 1, 1).select(F.concat_ws("\t", F.concat(F.lit("O"), F.col("id").cast("string")), F.lit("r"), F.concat(F.lit("P"), (F.col("id") % 50).cast("string"))).alias("value"))
    lines.write.text(str(tmp_path / "train.txt"))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared_root(spark)) for f in names if f.endswith(".parquet"))
    before = size()
    read = R.read_triples(spark, str(tmp_path / "train.txt"))
    assert size() - before < 3 * 200_000
    assert read.agg(F.min("idx"), F.max("idx"), F.count_distinct("idx"), F.count_if(F.col("src") != F.concat(F.lit("O"), F.col("idx").cast("string")))).first()[:] == (0, 199_999, 200_000, 0)
