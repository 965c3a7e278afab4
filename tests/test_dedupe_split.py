"""Duplicates (A1, A2, J1), split (T4, T5), sequential ids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from issuelens.operators import dedupe, split

WL = ["ok"]


def _issues(spark, rows):
    return spark.createDataFrame(rows, "repo STRING, id BIGINT, title STRING, body STRING, labels STRING")


def test_bad_ids_as_written(spark):
    rows = [("r", 1, "t", "b", "ok"), ("r", 2, "t", "b", "ok"), ("r", 3, "t", "b", "ok"),      # agreeing x3
            ("r", 4, "u", "c", "ok"), ("r", 5, "u", "c", "ok2"),                              # conflicting
            ("r", 6, "v", "d", "ok"), ("r", 7, "v", "d", "no"),                               # one not whitelisted
            ("s", 8, "t", "b", "ok")]                                                         # other repo
    iss = _issues(spark, rows)
    bad = sorted(r["id"] for r in dedupe.bad_ids(iss, WL + ["ok2"]).collect())
    assert bad == [1, 4, 5]
    keep_one = sorted(r["id"] for r in dedupe.bad_ids(iss, WL + ["ok2"], keep_one=True).collect())
    assert keep_one == [2, 3, 4, 5]
    left = sorted(r["id"] for r in dedupe.remove_duplicates(iss, dedupe.bad_ids(iss, WL + ["ok2"])).collect())
    assert left == [2, 3, 6, 7, 8]


def test_removal_stays_in_the_repo(spark):
    """Issue 1 is a copy in repo a; issue 1 of repo b is another text and stays."""
    rows = [("a", 1, "t", "b", "ok"), ("a", 2, "t", "b", "ok"), ("b", 1, "u", "c", "ok"), ("b", 2, "t", "b", "no")]
    iss = _issues(spark, rows)
    bad = dedupe.bad_ids(iss, WL)
    assert [tuple(r) for r in bad.collect()] == [("a", 1)]
    left = sorted((r["repo"], r["id"]) for r in dedupe.remove_duplicates(iss, bad).collect())
    assert left == [("a", 2), ("b", 1), ("b", 2)]


@pytest.mark.parametrize("n,k", [(10, 8), (11, 9), (15, 12), (1, 1), (0, 0)])
def test_split_sizes(spark, n, k):
    df = spark.range(n).select(F.col("id"))
    flagged = split.with_train_flag(df, 0.8, seed=1)
    assert flagged.filter("is_train").count() == k


def test_split_partition_invariant_and_ordered(spark):
    df = spark.range(5000).select(F.col("id"))
    a = {r["id"] for r in split.with_train_flag(df.coalesce(1), 0.8, 7).filter("is_train").collect()}
    b = {r["id"] for r in split.with_train_flag(df.repartition(8), 0.8, 7).filter("is_train").collect()}
    assert a == b and len(a) == 4000
    keyed = df.select("id", split.shuffle_key(F.col("id"), 7).alias("h"))
    first = {r["id"] for r in keyed.orderBy("h").limit(4000).collect()}
    assert a == first


def test_assign_ids_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("r").alias("repo"))
    out = dedupe.assign_ids(df, ["repo", "k"], num_partitions=5)
    rows = sorted((r["k"], r["seq_id"]) for r in out.collect())
    assert [s for _, s in rows] == list(range(1000))


def test_null_body_is_not_the_empty_body(spark):
    rows = spark.createDataFrame([("r", 1, "t", None, "L"), ("r", 2, "t", "", "L"), ("r", 3, "t", "", "L")],
                                 "repo STRING, id BIGINT, title STRING, body STRING, labels STRING")
    got = dedupe.duplicate_groups(rows, ["L"]).collect()
    assert [(g["min_id"], g["n_rows"]) for g in got] == [(2, 2)]


def test_bad_ids_follow_a_rewritten_input(spark, tmp_path):
    path = str(tmp_path / "issues")

    def write(second_label):
        spark.createDataFrame([("r", 1, "t", "b", "L"), ("r", 2, "t", "b", second_label)],
                              "repo STRING, id BIGINT, title STRING, body STRING, labels STRING").write.mode("overwrite").parquet(path)

    def bad():
        return sorted(r["id"] for r in dedupe.bad_ids(spark.read.parquet(path), ["L", "M"]).collect())

    write("M")
    assert bad() == [1, 2]
    write("L")
    assert bad() == [1]


def test_split_needs_named_groups(spark):
    import pytest
    from issuelens.operators import split
    with pytest.raises(ValueError):
        split.with_train_flag(spark.range(4).withColumn("g", F.lit("a")), group_col="g")


def test_split_is_exact_with_repeated_ids(spark):
    rows = [(7, f"text {i}", None if i % 3 else "x") for i in range(40)] + [(i, "other", None) for i in range(10)]
    df = spark.createDataFrame(rows, "id LONG, text STRING, more STRING")
    picked = []
    for parts in (1, 8):
        out = split.with_train_flag(df.repartition(parts), 0.5, 3).filter("is_train").collect()
        assert len(out) == 25
        picked.append({tuple(r) for r in out})
    assert picked[0] == picked[1]
    whole = spark.createDataFrame(rows[:40], "id LONG, text STRING, more STRING")
    assert split.with_train_flag(whole, 0.8).filter("is_train").count() == 32
    plan = split.with_train_flag(df.filter("id <> 7"), 0.5).select("id", "is_train")._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan
