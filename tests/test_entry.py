import importlib
import sys

import __spark_entry__


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("graphloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "graphloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        entry = importlib.reload(__spark_entry__)
        names = entry.queries()
        assert "kg_questions" in names
        assert not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
