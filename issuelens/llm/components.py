"""Connected components of an edge table by alternating large-star and small-star steps.

Nodes are longs.  Each step is one grouped minimum (combined before the shuffle, so a node
with a third of all edges costs one row per task) and one join, whose hot keys adaptive
execution may split.  Every round is written to the shared folder, so lineage stays
short and nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    out = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; a > b in ``edges``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    joined = edges.join(least, F.col("a") == F.col("n"))
    out = joined.select(F.explode(F.array(
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        F.struct(F.col("n").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    # Exclusive or does not overflow, however many edges there are; edges are distinct, so none cancel out.
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    e = stored(e, "edges")
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        e = stored(_small_star(_large_star(e)), "stars")
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
