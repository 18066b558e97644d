import json
import os

import pytest

import graphloom.catalogue
from graphloom.streaming import prediction_log as L

SCHEMA = "question_id string, recurrence_k int, adapter_control string, correct boolean, pos long"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(["question_id", "recurrence_k", "adapter_control", "correct", "pos"], r))) for r in rows))


def entries(spark, path):
    return sorted((r.question_id, r.recurrence_k, r.adapter_control, r.correct, r.pos) for r in L.read_entries(spark, path, schema=SCHEMA).collect())


def test_a_broken_and_restarted_stream_has_no_doubled_key(spark, tmp_path, monkeypatch):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    put(inbox, "a.json", [("q1", 1, "correct", False, 0), ("q2", 1, "correct", True, 1)])
    put(inbox, "b.json", [("q1", 1, "correct", True, 2), ("q3", 2, "correct", False, 3)])
    stream = lambda: L.read_log(spark, str(inbox), SCHEMA, files_per_batch=1)
    plain = L.batch_writer

    def breaking(path):
        write = plain(path)

        def then_break(batch, batch_id):
            write(batch, batch_id)
            if batch_id == 1:
                raise RuntimeError("lost after writing, before the commit")

        return then_break

    monkeypatch.setattr(L, "batch_writer", breaking)
    with pytest.raises(Exception, match="lost after writing"):
        L.append_stream(stream(), out, checkpoint).awaitTermination()
    monkeypatch.setattr(L, "batch_writer", plain)
    L.append_stream(stream(), out, checkpoint).awaitTermination()
    assert spark.read.schema(SCHEMA).json(f"{out}/*").count() == 4
    want = [("q1", 1, "correct", True, 2), ("q2", 1, "correct", True, 1), ("q3", 2, "correct", False, 3)]
    assert entries(spark, out) == want
    # compaction, then more batches
    assert L.compact(spark, out, schema=SCHEMA) == 1 and entries(spark, out) == want
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["through-1"]
    put(inbox, "c.json", [("q2", 1, "correct", False, 0), (None, None, None, True, 9), ("q2", 1, "correct", None, -1)])
    L.append_stream(stream(), out, checkpoint).awaitTermination()
    found = {r.question_id: (r.correct, r.pos) for r in L.read_entries(spark, out, schema=SCHEMA).collect()}
    assert found == {"q1": (True, 2), "q2": (False, 0), "q3": (False, 3), None: (True, 9)}
    assert L.compact(spark, out, schema=SCHEMA) == 2 and L.compact(spark, out, schema=SCHEMA) == 2
    assert {r.question_id: (r.correct, r.pos) for r in L.read_entries(spark, out, schema=SCHEMA).collect()} == found


def test_a_compaction_that_broke_off_is_ignored(spark, tmp_path):
    out = tmp_path / "out"
    spark.createDataFrame([("q", 1, "none", True, 5)], SCHEMA).write.json(str(out / "batch-0"))
    (out / "through-0").mkdir()
    put(out / "through-0", "part-0.json", [("q", 1, "none", False, 6)])
    assert entries(spark, str(out)) == [("q", 1, "none", True, 5)]
    assert L.compact(spark, str(out), schema=SCHEMA) == 0 and entries(spark, str(out)) == [("q", 1, "none", True, 5)]
    assert L.read_entries(spark, str(tmp_path / "nothing"), schema=SCHEMA).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_parts_of_many_files_are_read_in_the_order_of_the_log(spark, tmp_path):
    from .oracle import canonical_rows, connect

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(7, "value").write.parquet(str(tmp_path / "events.parquet"))
    found = graphloom.catalogue.QUERIES["prediction_stream"](spark, str(tmp_path))
    want = connect("/root/testdata/sf0.001").sql(graphloom.catalogue.ORACLE_SQL["prediction_stream"])
    assert canonical_rows(found.columns, found.collect()) == canonical_rows(want.columns, want.fetchall())
