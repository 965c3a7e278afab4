"""Every catalog query with a SQL twin equals DuckDB on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from issuelens.plans.catalog import entries
from issuelens.sources.tables import TABLES, table_path

SQL_KEYS = sorted(k for k, e in entries().items() if e.sql is not None)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


# Spark type -> DuckDB type name, for the schema comparison.
TYPE_NAMES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
              "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(sf_small, t)}')")
    yield con
    con.close()


@pytest.mark.parametrize("key", SQL_KEYS)
def test_query_matches_sql(spark, sf_small, duck, key):
    e = entries()[key]
    sdf = e.query(spark, sf_small)
    srows = sdf.collect()
    rel = duck.sql(e.sql)
    dcols, dtypes = rel.columns, [str(t) for t in rel.types]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    stypes = {f.name: TYPE_NAMES.get(repr(f.dataType), repr(f.dataType)) for f in sdf.schema.fields}
    assert stypes == dict(zip(dcols, dtypes))
    assert _bag(sdf.columns, srows) == _bag(dcols, drows)
