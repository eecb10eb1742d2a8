import importlib
import sys


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_text_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "sightline.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    for m in [m for m in sys.modules if m.startswith("sightline.llm.")]:
        monkeypatch.delitem(sys.modules, m)
    import __spark_entry__ as e

    e = importlib.reload(e)
    assert "search_outcomes" in e.queries() and not any(q.startswith("op") and q[2].isdigit() for q in e.queries())
    monkeypatch.undo()
    importlib.reload(e)
