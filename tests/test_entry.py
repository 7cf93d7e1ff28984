import importlib
import sys

import pytest


@pytest.fixture
def entry(monkeypatch):
    """The entry module, and every module of the text part forgotten before and after."""
    def forget():
        for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tidewatch.llm")]:
            monkeypatch.delitem(sys.modules, name)
    forget()
    return importlib.import_module("__spark_entry__")


def core():
    from suite import families
    return {name for family in families() for name in family.QUERIES}


def test_queries_survive_a_missing_library_and_an_empty_folder(entry, monkeypatch, tmp_path):
    known = core()
    assert len(known) > 140
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert known <= set(entry.queries()) and not [n for n in entry.queries() if n.startswith("op2_")] and "pipeline" not in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_survive_an_empty_subpackage(entry, monkeypatch, tmp_path):
    import tidewatch
    known = core()
    (tmp_path / "llm" / "__pycache__").mkdir(parents=True)
    monkeypatch.setattr(tidewatch, "__path__", [str(tmp_path), *(p for p in tidewatch.__path__)][:1])
    for name in [m for m in sys.modules if m == "tidewatch.llm" or m.startswith("tidewatch.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == known and set(entry.oracle_sql()) <= known
