"""The driver's entry points, with and without the training-data operators."""

import importlib
import importlib.util
import sys


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first().n > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_training_data(monkeypatch):
    import __spark_entry__ as e

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("praxilog.llm", "corpus_pipeline") else real(n, *a))
    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("praxilog.llm") or k == "corpus_pipeline"}
    try:
        assert not any(k.startswith("op") or k == "pipeline" for k in e.queries())
        assert not any(k.startswith("praxilog.llm") for k in sys.modules)
    finally:
        sys.modules.update(kept)
