"""Duplicate issues (A1, A2, J1), bad-id files (S7), sequential ids.

Duplicates are whitelisted posts of one repo with equal (body, title).  Groups
are formed on a SHA-256 of the length-prefixed texts, so the shuffle carries
32-byte keys instead of whole texts.  A group's ids are never collected:
group statistics come from a map-side-combined aggregate, and the ids of
conflicting groups are found by joining the rows back to the set of conflicting
group keys.  Adaptive execution picks the join by the side's measured bytes and
splits hot keys, so a group holding a third of all rows costs no single task
more than its share.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .labels import whitelist_labels


def text_key(cols: Sequence[str] = ("body", "title")) -> Column:
    """Unambiguous content key: sha256 of length-prefixed fields; null is not the empty text."""
    parts = []
    for c in cols:
        length = F.coalesce(F.length(c).cast("string"), F.lit("null"))
        parts += [length, F.lit(":"), F.coalesce(F.col(c), F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def _keyed(issues: DataFrame, whitelist: Iterable[str]) -> DataFrame:
    return whitelist_labels(issues, whitelist).select(
        "repo", "id", "labels", text_key().alias("_key"))


def duplicate_groups(issues: DataFrame, whitelist: Iterable[str]) -> DataFrame:
    """A1: per repo, groups of whitelisted posts with equal (body, title) and
    more than one row: ``(repo, _key, min_id, n_rows, conflicting)``."""
    return (_keyed(issues, whitelist).groupBy("repo", "_key")
            .agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("n_rows"),
                 (F.min("labels") != F.max("labels")).alias("conflicting"))
            .filter(F.col("n_rows") > 1))


def bad_ids(issues: DataFrame, whitelist: Iterable[str], keep_one: bool = False) -> DataFrame:
    """A2: ids to drop, ``(repo, id)`` distinct.

    Agreeing labels: only the first id (= smallest, ids follow file order) is
    bad, whatever the group size (Q7, as written); ``keep_one=True`` instead
    drops all but the first.  Conflicting labels: every id is bad.
    """
    keyed = _keyed(issues, whitelist)
    groups = duplicate_groups(issues, whitelist)
    if not keep_one:
        agreeing = groups.filter(~F.col("conflicting")).select("repo", F.col("min_id").alias("id"))
        conflict_keys = groups.filter(F.col("conflicting")).select("repo", "_key")
        conflicting = keyed.join(conflict_keys, ["repo", "_key"], "left_semi").select("repo", "id")
        return agreeing.unionByName(conflicting).distinct()
    keys = groups.select("repo", "_key", "min_id", "conflicting")
    rows = keyed.join(keys, ["repo", "_key"], "inner")
    return rows.filter(F.col("conflicting") | (F.col("id") != F.col("min_id"))).select("repo", "id").distinct()


def remove_duplicates(issues: DataFrame, bad: DataFrame) -> DataFrame:
    """Drop every post (whitelisted or not) whose id is bad in its own repo
    (anti join on both: each repo has its own list, and ids may repeat across repos)."""
    return issues.join(bad.select("repo", "id"), ["repo", "id"], "left_anti")


def write_bad_ids(bad: DataFrame, path: str) -> None:
    """S7 (write): per repo, sorted ids as text, one per line.

    A range partition on (repo, id) spreads a large repo over several tasks;
    each writes one sorted file whose range follows the previous file's.
    """
    (bad.select("repo", "id").repartitionByRange("repo", "id").sortWithinPartitions("repo", "id")
     .select("repo", F.col("id").cast("string").alias("value"))
     .write.mode("overwrite").partitionBy("repo").text(path))


def read_bad_ids(spark: SparkSession, path: str) -> DataFrame:
    """S7 (read): ``(repo, id)`` from the text files (repo from the folder)."""
    return spark.read.text(path).select("repo", F.trim("value").cast("bigint").alias("id"))


def bad_ids_roundtrip(spark: SparkSession, bad: DataFrame) -> DataFrame:
    path = scratch_path(spark, "bad_ids")
    write_bad_ids(bad, path)
    return read_bad_ids(spark, path)


def assign_ids(df: DataFrame, order_cols: Sequence[str], id_col: str = "seq_id",
               num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based ids in ``order_cols`` order, without a single-task window.

    Range-partition and sort, tag each row with (partition, position) from
    ``monotonically_increasing_id`` (partition in the high bits, position in
    the low 33), checkpoint that to the shared folder so recomputation cannot
    reshuffle it, then add the per-partition offsets (a table with one row per
    partition, broadcast).
    """
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n_parts, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    scratch_path(spark, "ids")  # make sure the shared checkpoint folder is set
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a bounded side; the running sum runs over it only.
    from pyspark.sql import Window
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    out = tagged.join(F.broadcast(offsets.select("_part", "_off")), "_part")
    return out.withColumn(id_col, F.col("_off") + F.col("_pos")).drop("_mid", "_part", "_pos", "_off")
