"""Query catalog: key -> (Spark query, SQL oracle or None).

Every query reads the driver tables of one scale-factor folder (or data Spark
derives from them) and returns a DataFrame; nothing is collected here except
bounded histograms inside the split operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    key: str
    query: QueryFn
    sql: str | None
    ref: str  # SURVEY inventory id


_REGISTRY: dict[str, Entry] = {}


def register(key: str, ref: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in _REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        _REGISTRY[key] = Entry(key, fn, sql, ref)
        return fn
    return deco


def entries() -> dict[str, Entry]:
    _load()
    return dict(_REGISTRY)


def _load() -> None:
    # Importing the query modules fills the registry.
    from . import corpus_queries, io_queries, model_queries, queries, vector_queries  # noqa: F401
