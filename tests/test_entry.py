"""The driver's contract holds with and without the optional corpus operators."""

import importlib
import sys

import __spark_entry__ as entry


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 100


def test_without_corpus_operators(monkeypatch):
    real = importlib.import_module

    def gone(name, *a):
        if name.startswith(("ruleweave.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry.queries())
    assert len(entry.queries()) >= 100


def test_without_what_they_need(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert len(entry.queries()) >= 100 and "pipeline" not in entry.queries()


def test_entry(spark):
    row = entry.entry(spark).collect()[0]
    assert row.n > 0 and row.revenue > 0
