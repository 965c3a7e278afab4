from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return brute.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    """An empty table of documents."""
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The documents with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F
    names = ("key", "size", "n_words", "kept", "_row", "_key", "_kept", "_digest", "_size", "_source", "_edge", "_n", "id", "band")
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
