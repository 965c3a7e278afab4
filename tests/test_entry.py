"""The driver contract in ``__spark_entry__``."""

from __future__ import annotations

import importlib


def test_entry_contract(spark):
    m = importlib.import_module("__spark_entry__")
    q, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 80
    df = m.entry(spark)
    assert df.columns and df.count() >= 0


def test_model_roundtrip_predictions_equal(spark, sf_small):
    m = importlib.import_module("__spark_entry__")
    rows = m.queries()["model_roundtrip"](spark, sf_small).collect()
    assert rows and all(r["same"] for r in rows)
