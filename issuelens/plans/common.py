"""Shared inputs of the catalog queries, in Spark and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels, split
from ..sources import tables
from . import oracle as O

SHARE = 0.8
SEED = 1


def issues(spark: SparkSession, sf: str) -> DataFrame:
    return tables.issues(spark, sf)


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled issues of the mapped repos with ``label`` and ``split``."""
    return labels.assemble_dataset(issues(spark, sf), labels.label_map_frame(spark))


def flagged(spark: SparkSession, sf: str, seed: int = SEED) -> DataFrame:
    return split.with_train_flag(dataset(spark, sf), SHARE, seed, group_col="split", groups=("seen",))


def test_sets(spark: SparkSession, sf: str, seed: int = SEED) -> DataFrame:
    """Held-out 20 % of the seen repos plus all unseen rows, with X."""
    return flagged(spark, sf, seed).filter(~F.col("is_train")).withColumn("X", T.concat_features())


# --- SQL side ---------------------------------------------------------------------

def ctes_dataset() -> list[tuple[str, str]]:
    return O.base_ctes() + [("ds", O.dataset_cte())]


def ctes_flagged(seed: int = SEED) -> list[tuple[str, str]]:
    return ctes_dataset() + [("fl", O.flagged_cte("ds", SHARE, seed))]


def ctes_test(seed: int = SEED) -> list[tuple[str, str]]:
    return ctes_flagged(seed) + [("te", f"select *, {O.concat_features()} as X from fl where not is_train")]
