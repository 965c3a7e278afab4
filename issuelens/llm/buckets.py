"""From shared buckets to components, without emitting all pairs of a bucket.

``banded`` holds (band, key) rows.  Members of a bucket are first compared with two
pivots, the bucket's least and greatest key; what links is joined to components.
After that only pairs of different components are compared, so a bucket of near copies costs rows in proportion to its members.
Members of a bucket that is large still (unlike, with a template in common) are put in buckets anew, by
keys of which every similar pair shares one and unlike members hardly any; all are compared pair by pair,
in blocks, so no candidate pair that could change a component is left out.  All steps are grouped aggregates and joins on bucket
or key, whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, marked
from .common import stored
from .components import components

LARGE = 2048            # members of a bucket that are compared with each other at once

Verify = Callable[[DataFrame], DataFrame]


def shared_buckets(banded: DataFrame) -> DataFrame:
    """Stored (band, key) of the buckets with more than one member."""
    full = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"), "full-buckets")
    # Most keys are alone in their bucket; a bitmap leaves them out before the shuffle.
    likely = marked(banded, *bitmap(full, full.count(), "band"), "band")
    return stored(likely.join(full, "band").select("band", "key"), "buckets")


def pivot_pairs(shared: DataFrame) -> DataFrame:
    """Stored (a, b): every member with its bucket's least and greatest key."""
    ends = shared.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high")
    pairs = shared.join(ends, "band").select("key", F.explode(F.array("low", "high")).alias("pivot")).filter("key <> pivot")
    return stored(pairs.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct(), "pivot-pairs")


def mixed_buckets(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, key, part) of the buckets that hold more than one component of ``groups``."""
    tagged = shared.join(groups, F.col("key") == F.col("node"), "left")
    tagged = stored(tagged.select("band", "key", F.coalesce("component", "key").alias("part")), "bucket-parts")
    mixed = tagged.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("band")
    return tagged.join(mixed, "band", "left_semi")


def grown(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``groups`` and the links together."""
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))


def split_buckets(tagged: DataFrame, finer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored (band, key, part, own): buckets of more than ``LARGE`` members give way to the finer ones of their members.

    ``own`` is false for the finer ones.  They bring every similar pair of a large bucket together."""
    tagged = tagged.withColumn("own", F.lit(True))
    sizes = tagged.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    big = stored(sizes.filter(F.col("n") > LARGE).select("band"), "large-buckets")
    if big.isEmpty():
        return tagged
    parts = stored(tagged.join(big, "band", "left_semi").select("key", "part").distinct(), "large-members")
    again = stored(finer(parts.select("key")).join(parts, "key").select("band", "key", "part", F.lit(False).alias("own")), "finer-buckets")
    mixed = again.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("band")
    return stored(tagged.join(big, "band", "left_anti").unionByName(again.join(mixed, "band", "left_semi")), "split-buckets")


def in_blocks(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides whose equal (band, low, high) bring all pairs of a bucket together.

    A bucket is cut into blocks of about ``LARGE`` members, and each pair of blocks is a key of its
    own, so no key has more than two blocks' members, however large the bucket is.
    """
    sizes = tagged.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(LARGE)).cast("int").alias("blocks"))
    t = tagged.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("key", "band"), F.col("blocks")).cast("int"))
    left = t.select("band", "key", "part", F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"))
    right = t.select("band", "key", "part", F.explode(F.sequence(F.lit(0), "block")).alias("low"), F.col("block").alias("high"))
    return left, right


def linked(banded: DataFrame, prepare: Callable[[DataFrame], tuple[DataFrame, Callable[[str, str], Column], Verify, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(node, component) for keys that link with another.

    ``prepare`` gets the stored candidate keys (key) and returns a table (key, sketch) with one
    row a key, a condition on two sketch columns that every linked pair fulfils, the
    test that turns pairs (a, b) into the linked pairs among them, and a function from keys
    (key) to (band, key) with a band in common for every linked pair, for the members of large buckets.
    """
    shared = shared_buckets(banded)
    sketches, near, test, finer = prepare(stored(shared.select("key").distinct(), "candidates"))
    of_a = sketches.select(F.col("key").alias("a"), F.col("sketch").alias("sketch_a"))
    of_b = sketches.select(F.col("key").alias("b"), F.col("sketch").alias("sketch_b"))
    first = pivot_pairs(shared)
    likely = first.join(of_b, "b").join(of_a, "a").filter(near("sketch_a", "sketch_b")).select("a", "b")
    once = stored(components(stored(test(likely), "pivot-links")), "first-components")
    # Unlike pairs of a bucket are never rows, nor is a pair a row in more than one bucket of its own: both
    # conditions are part of the join.  Finer buckets, which may be many a key, are not listed.
    tagged = split_buckets(mixed_buckets(shared, once), finer)
    lists = sketches.join(tagged.groupBy("key").agg(F.collect_list(F.when(F.col("own"), F.col("band"))).alias("bands")), "key")
    left, right = (side.join(lists, "key").select(*[F.col(c).alias(f"{c}_{k}") for c in ("band", "low", "high", "part", "sketch", "bands")], F.col("key").alias(k))
                   for side, k in zip(in_blocks(tagged), ("a", "b"), strict=True))
    same = (F.col("band_a") == F.col("band_b")) & (F.col("low_a") == F.col("low_b")) & (F.col("high_a") == F.col("high_b"))
    once_each = (F.col("low_a") < F.col("high_a")) | (F.col("a") < F.col("b"))
    least = F.array_min(F.array_intersect("bands_a", "bands_b"))
    rest = left.join(right, same & once_each & (F.col("part_a") != F.col("part_b"))
                     & near("sketch_a", "sketch_b") & (least.isNull() | (least == F.col("band_a"))))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stored(test(rest.join(first, ["a", "b"], "left_anti")), "other-links")
    return grown(once, more)
