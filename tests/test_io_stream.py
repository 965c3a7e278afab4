"""Sources, sinks and the incremental labelling stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from issuelens.session import scratch_path
from issuelens.sources import io
from issuelens.streaming import incremental as R


def _write_text(spark, path, lines):
    spark.createDataFrame([(l,) for l in lines], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def test_scan_json_array_dump_repo_from_file_name(spark, tmp_path):
    # A reference-style dump: one JSON array per repo file.
    for repo, ids in (("rust", [0, 1]), ("flutter", [2])):
        recs = [{"title": f"t{i}", "body": f"b{i}", "labels": "C-bug", "id": i} for i in ids]
        (tmp_path / f"{repo}_removed_dups.json").write_text(json.dumps(recs))
    df = io.scan_issues(spark, str(tmp_path), repo_pattern=io.REPO_FROM_FILE, json_array=True)
    got = sorted((r["repo"], r["id"]) for r in df.collect())
    assert got == [("flutter", 2), ("rust", 0), ("rust", 1)]


def test_scrape_specs_empty_and_malformed(spark):
    path = scratch_path(spark, "specs-test")
    _write_text(spark, path, ['{"repo": "rust", "desired_labels": ["C-bug", "T-doc"]}',
                              '{"repo": "openwb", "desired_labels": []}',
                              '{"repo": "electron", "desired_labels": ["bug"]}'])
    got = sorted(((r["repo"], r["desired_label"]) for r in io.read_scrape_specs(spark, path).collect()),
                 key=str)
    assert got == [("electron", "bug"), ("openwb", None), ("rust", "C-bug"), ("rust", "T-doc")]
    bad = scratch_path(spark, "specs-test")
    _write_text(spark, bad, ['{"repo": "rust", "desired_labels": ["C-bug"]}', '{"repo": "electron", "desired_labels": [bug]}'])
    with pytest.raises(Exception, match="malformed scrape spec"):
        io.read_scrape_specs(spark, bad).collect()


def test_broken_dump_fails_the_read(spark, tmp_path):
    (tmp_path / "rust.json").write_text('[{"title": "t", "body": "b", "labels": "C-bug", "id": 1}, {"title": oops}]')
    with pytest.raises(Exception):
        io.scan_issues(spark, str(tmp_path), repo_pattern=io.REPO_FROM_FILE, json_array=True).collect()


def test_normalise_dump_drops_prs_and_unwanted_labels(spark):
    raw = spark.createDataFrame([
        ("r", 1, "a", "x", None, [("bug",), ("triage",)]),
        ("r", 2, "b", "y", ("u",), [("bug",)]),          # pull request
        ("s", 3, "c", "z", None, [("misc",), ("x",)]),   # repo without a label filter: once
        ("s", 4, "d", "z", None, []),                    # also without labels
        ("r", 5, "e", "z", None, []),
    ], "repo STRING, id BIGINT, title STRING, body STRING, pull_request STRUCT<url: STRING>, "
       "labels ARRAY<STRUCT<name: STRING>>")
    specs = spark.createDataFrame([("r", "bug"), ("s", None)], "repo STRING, desired_label STRING")
    got = sorted((r["id"], r["labels"]) for r in io.normalise_dump(raw, specs).collect())
    assert got == [(1, "bug"), (3, None), (4, None)]


def test_label_sink_is_idempotent(spark):
    path = scratch_path(spark, "sink-test")
    rows = spark.createDataFrame([("a", 1, "bug"), ("a", 2, None), ("a", 3, "feature"), ("a", 3, "feature"), ("a", 4, "doc"),
                                  ("a", 4, "bug"), ("b", 1, "doc")], "repo STRING, issue_num BIGINT, label STRING")
    io.append_labels(rows, path)
    io.append_labels(rows, path)
    got = sorted((r["repo"], r["issue_num"], r["label"]) for r in io.read_sink(spark, path).collect())
    assert got == [("a", 1, "bug"), ("a", 3, "feature"), ("a", 4, "bug"), ("b", 1, "doc")]


def test_a_batch_reads_its_own_folders_of_the_sink(spark):
    path = scratch_path(spark, "sink-test")
    schema = "repo STRING, issue_num BIGINT, label STRING"
    io.append_labels(spark.createDataFrame([(r, i * io.SINK_BUCKET + 1, "bug") for r in "abc" for i in range(5)], schema), path)
    new = spark.createDataFrame([("a", 1, "doc"), ("a", 2, "doc"), ("b", 4 * io.SINK_BUCKET + 9, "doc")], schema)
    rows = new.withColumn("bucket", F.floor(F.col("issue_num") / io.SINK_BUCKET).cast("int"))
    read = io.in_folders_of(rows, io.read_sink(spark, path))
    assert {f.split("repo=")[1].rsplit("/", 1)[0] for f in read.inputFiles()} >= {"a/bucket=0", "b/bucket=4"}
    assert sorted((r["repo"], r["issue_num"]) for r in read.collect()) == [("a", 1), ("b", 4 * io.SINK_BUCKET + 1)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    io.append_labels(new, path)
    assert io.read_sink(spark, path).count() == 17
    assert io.in_folders_of(rows, io.read_sink(spark, path), most=1).count() == 17


def test_the_stream_never_reads_its_sink(spark):
    """The plan of a batch scans the snapshots alone, and no text is shuffled."""
    snaps = spark.createDataFrame([("a", 1, "x", "panic error", "https://x/issues/12", 100, None, [])], R.SNAPSHOT_SCHEMA)
    source = scratch_path(spark, "src-test")
    snaps.write.parquet(source)
    stream = spark.readStream.schema(R.SNAPSHOT_SCHEMA).parquet(source)
    plan = R.labelled_stream(stream, F.lit(100.0), 50)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and plan.count("StreamingRelation") == 1
    narrow = R.judged(stream, F.lit(100.0), 50).columns
    assert not {"title", "body", "X"} & set(narrow)


def test_restart_from_the_checkpoint_with_a_replayed_batch(spark):
    """State outlives the run; a batch that is run again writes the same rows over its own."""
    snap = lambda n, t: ("a", n, "x", "panic error on build", f"https://x/issues/{n}", t, None, [])
    source, sink, ckpt = (scratch_path(spark, n) for n in ("src-test", "sink-test", "ckpt-test"))
    for first, last in ((1, 20), (11, 30), (1, 30)):
        spark.createDataFrame([snap(n, 100) for n in range(first, last + 1)], R.SNAPSHOT_SCHEMA).write.mode("append").parquet(source)
        R.run_incremental(spark, source, sink, ckpt, as_of=100, delta_seconds=50)
    rows = R.read_labels(spark, sink)
    assert sorted(r["issue_num"] for r in rows.collect()) == list(range(1, 31))
    R.write_batch(spark.createDataFrame([("a", 1, "bug")], "repo STRING, issue_num BIGINT, label STRING"), 77, sink)
    R.write_batch(spark.createDataFrame([("a", 1, "bug")], "repo STRING, issue_num BIGINT, label STRING"), 77, sink)
    assert R.read_labels(spark, sink).count() == 31
    to = scratch_path(spark, "compact-test")
    R.compact_labels(spark, sink, to)
    assert spark.read.parquet(to).count() == 31


def test_only_a_missing_sink_reads_as_none(spark, tmp_path):
    assert io.read_sink(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        io.read_sink(spark, str(tmp_path)).collect()


def test_stream_takes_latest_state_and_keeps_repos_apart(spark):
    body = "panic error on build"
    snaps = spark.createDataFrame([
        ("a", 1, "x", body, "https://x/issues/12", 100, None, []),
        ("a", 1, "x", body, "https://x/issues/12", 110, None, ["done"]),   # labelled meanwhile
        ("a", 2, "x", body, "https://x/issues/13", 100, None, []),
        ("b", 3, "x", body, "https://x/issues/13", 100, None, []),         # same number, other repo
    ], R.SNAPSHOT_SCHEMA)
    source, sink, ckpt = (scratch_path(spark, n) for n in ("src-test", "sink-test", "ckpt-test"))
    snaps.write.parquet(source)
    clock = iter([100.0] * 9)
    R.run_incremental(spark, source, sink, ckpt, as_of=lambda: next(clock), delta_seconds=50)
    got = sorted((r["repo"], r["issue_num"]) for r in R.read_labels(spark, sink).collect())
    assert got == [("a", 13), ("b", 13)]


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        class conf:
            get = staticmethod(lambda key, default=None: default)

    from issuelens.session import shared_dir
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_incremental_stream_labels_nothing_twice(spark):
    snaps = spark.createDataFrame([
        ("r", 1, "crash", "panic error on build", "https://x/issues/1", 100, None, []),
        ("r", 2, "docs", "guide example", "https://x/issues/2", 100, None, ["done"]),     # labelled
        ("r", 3, "old", "panic error", "https://x/issues/3", 10, None, []),               # not recent
        ("r", 4, "pr", "panic error", "https://x/issues/4", 100, "https://x/pull/4", []), # pull request
        ("r", 5, "hmm", "zzz", "https://x/issues/5", 100, None, []),                      # abstains
    ], R.SNAPSHOT_SCHEMA)
    source, sink, ckpt = (scratch_path(spark, n) for n in ("src-test", "sink-test", "ckpt-test"))
    snaps.write.mode("append").parquet(source)
    R.run_incremental(spark, source, sink, ckpt, as_of=100, delta_seconds=50)
    first = sorted(tuple(r) for r in R.read_labels(spark, sink).collect())
    assert first == [("r", 1, "bug")]
    # A later edit of issue 1 and a replay of everything: nothing new is labelled.
    snaps.withColumn("updated_s", F.col("updated_s") + 1).write.mode("append").parquet(source)
    R.run_incremental(spark, source, sink, ckpt, as_of=100, delta_seconds=50)
    assert sorted(tuple(r) for r in R.read_labels(spark, sink).collect()) == first


def test_array_dumps_are_read_by_many_tasks(spark, tmp_path):
    rows = [{"title": f"t{i}", "body": b, "labels": "bug", "id": i} for i, b in enumerate(
        ["plain", None, "ends with },{", '"},{"title":"x"', "[1]", "]", "", "\n ü \u2028 {", "x" * 3000] * 60)]
    (tmp_path / "rust.json").write_text(json.dumps(rows, separators=(",", ":"), ensure_ascii=False))
    (tmp_path / "go_removed_dups.json").write_text(json.dumps(rows[:9], indent=2))
    (tmp_path / "one.json").write_text(json.dumps(rows[:1], separators=(",", ":")) + "\n")
    (tmp_path / "none.json").write_text("[]")
    want = {("rust", r["id"], r["body"]) for r in rows} | {("go", r["id"], r["body"]) for r in rows[:9]} | {("one", 0, "plain")}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = io.scan_array_dumps(spark, str(tmp_path))
        found = got.select("repo", "id", "body", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(found) == len(want) and {tuple(r)[:3] for r in found} == want
    assert len({r["task"] for r in found if r["repo"] == "rust"}) > 5
    spaced = tmp_path / "spaced"
    spaced.mkdir()
    (spaced / "rust.json").write_text(json.dumps(rows))
    assert io.scan_array_dumps(spark, str(spaced), between=", ").count() == len(rows)
    assert io.scan_array_dumps(spark, str(spaced)).count() == len(rows)


@pytest.mark.parametrize("broken", [lambda t: t[:-1], lambda t: t[:-2], lambda t: t[:-40], lambda t: t[1:], lambda t: t.replace('"id":3', '"id":')])
def test_a_broken_array_dump_raises(spark, tmp_path, broken):
    text = json.dumps([{"title": f"t{i}", "body": "b", "labels": "bug", "id": i} for i in range(5)], separators=(",", ":"))
    (tmp_path / "rust.json").write_text(broken(text))
    with pytest.raises(Exception, match="MALFORMED_RECORD|malformed|Malformed"):
        io.scan_array_dumps(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        io.scan_array_dumps(spark, str(tmp_path), io.RAW_SCHEMA)


def test_a_folder_of_the_sink_is_one_file(spark, tmp_path):
    """Dealt by number, each of the 8 tasks would write a file to each folder."""
    rows = spark.createDataFrame([("a", i, "bug") for i in range(2 * io.SINK_BUCKET)], "repo STRING, issue_num BIGINT, label STRING")
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        io.append_labels(rows.repartition(8), str(tmp_path / "sink"))
    finally:
        spark.conf.set(conf, was)
    assert len(list((tmp_path / "sink").rglob("*.parquet"))) == 2
    assert io.read_sink(spark, str(tmp_path / "sink")).count() == 2 * io.SINK_BUCKET


def test_state_is_kept_by_stretches_of_numbers(spark):
    """600 issues and one without a number: state rows of stretches, not of issues; later snapshots add nothing."""
    source, sink, ckpt = (scratch_path(spark, n) for n in ("src-test", "sink-test", "ckpt-test"))
    rows = [("a", i, "panic", "error", f"https://x/issues/{i}", 90, None, []) for i in range(600)]
    rows.append(("a", 0, "panic", "error", None, 90, None, []))
    spark.createDataFrame(rows, R.SNAPSHOT_SCHEMA).write.parquet(source)
    stream = R.labelled_stream(spark.readStream.schema(R.SNAPSHOT_SCHEMA).parquet(source), F.lit(100.0), 50)
    query = stream.writeStream.outputMode("append").foreachBatch(lambda b, i: R.write_batch(b, i, sink)).option(
        "checkpointLocation", ckpt).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) <= 4
    numbers = [r["issue_num"] for r in R.read_labels(spark, sink).collect()]
    assert sorted(n for n in numbers if n is not None) == list(range(600))
    assert numbers.count(None) <= 1
