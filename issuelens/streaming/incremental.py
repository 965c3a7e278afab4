"""Incremental labelling (R1): label recently updated, still unlabelled issues.

A Structured Streaming job over a folder of issue snapshots (file source,
explicit schema).  The labeller's steps run as Column expressions in the scan task: clean (F5,
labeller order) -> score -> name (F17), and whether the snapshot qualifies: recent (P8),
unlabelled (P7), no pull request (Q14).  What is shuffled is a narrow row without text.  A state
store keyed by (repo, stretch of numbers) then takes each issue's latest snapshot of the batch, since only the
current state counts, and lets a label through if it qualifies and the issue was
not labelled before.  State is a bit per labelled issue (a stretch has 2^``STRETCH_BITS`` numbers, so Python is called per
stretch, not per issue), in RocksDB with its changes in the
checkpoint, so a batch costs what its own issues cost: the sink is never read, however large it has become.

Each batch overwrites its own folder of the sink, so a replayed batch writes
the same rows again, and a restart from the checkpoint labels nothing twice.  Runs once over what is
there (``availableNow``) or, with ``interval``, on a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import text as T
from ..operators import keyword

SNAPSHOT_SCHEMA = ("repo STRING, id BIGINT, title STRING, body STRING, url STRING, updated_s BIGINT, "
                   "pull_request STRING, label_names ARRAY<STRING>")
# Label text posted per class code (feature, bug, doc).
LABEL_NAMES = ("feature", "bug", "documentation")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SINK_FILES = 8   # files a batch writes at most
STRETCH_BITS = 8

Scorer = Callable[[DataFrame], DataFrame]


def keyword_scorer(df: DataFrame) -> DataFrame:
    """Default scorer: the keyword classifier on the cleaned text ``X``."""
    return df.withColumn("pred", keyword.keyword_classify(F.col("X")))


def labeller_text() -> Column:
    """The labeller's input: ``title + ' ' + body``, code blocks then URLs removed."""
    return T.clean(T.concat_features(trailing=False), T.LABELLER_STEPS)


def judged(snapshots: DataFrame, as_of: Column, delta_seconds: float, scorer: Scorer = keyword_scorer,
           names: Sequence[str | None] = LABEL_NAMES, include_pull_requests: bool = False) -> DataFrame:
    """One narrow row per snapshot: its issue, its place among the issue's snapshots, its label, and whether that is wanted."""
    scored = scorer(snapshots.withColumn("X", labeller_text()))
    label = T.label_name("pred", names)
    wanted = (F.col("updated_s") >= as_of - F.lit(float(delta_seconds))) & (F.coalesce(F.size("label_names"), F.lit(0)) <= 0)
    if not include_pull_requests:
        wanted = wanted & F.col("pull_request").isNull()
    # A snapshot's texts only decide between snapshots that are equal otherwise, by their digest.
    texts = F.sha2(F.concat_ws("\n", F.length("title").cast("string"), "title", "body"), 256)
    return scored.select(
        "repo", T.issue_number("url").alias("issue_num"), "updated_s", F.coalesce(F.size("label_names"), F.lit(0)).alias("n_labels"),
        "pull_request", texts.alias("digest"), label.alias("label"), F.coalesce(wanted & label.isNotNull(), F.lit(False)).alias("wanted"))


def _first_labels(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The labels of a stretch's issues: of each, its latest snapshot in the batch, unless the issue has one already.

    Ties on the update time: a labelled or pull-request state wins, then the digest.  The state has a bit per
    number of the stretch.
    """
    held = int(state.get[0], 16) if state.exists else 0
    best: dict[int, tuple] = {}
    for f in frames:
        for bit, updated, n, pull, digest, label, wanted in zip(f["bit"], f["updated_s"], f["n_labels"], f["pull_request"], f["digest"], f["label"], f["wanted"], strict=True):
            if held >> int(bit) & 1:
                continue
            place = (not pd.isna(updated), 0 if pd.isna(updated) else updated, n, pull is not None, pull or "", digest)
            if bit not in best or place > best[bit][0]:
                best[bit] = place, label if wanted else None
    chosen = {int(bit): label for bit, (_, label) in sorted(best.items()) if label is not None}
    if chosen:
        state.update((f"{held | sum(1 << bit for bit in chosen):x}",))
        numbers = [None if pd.isna(key[1]) else (int(key[1]) << STRETCH_BITS) + bit for bit in chosen]
        yield pd.DataFrame({"repo": [key[0]] * len(chosen), "issue_num": pd.array(numbers, dtype="Int64"), "label": list(chosen.values())})


def labelled_stream(snapshots: DataFrame, as_of: Column, delta_seconds: float, scorer: Scorer = keyword_scorer,
                    names: Sequence[str | None] = LABEL_NAMES, include_pull_requests: bool = False) -> DataFrame:
    """The stream of ``(repo, issue_num, label)``, each issue at most once ever."""
    rows = judged(snapshots, as_of, delta_seconds, scorer, names, include_pull_requests)
    number = F.col("issue_num")
    rows = rows.select(F.shiftright(number, STRETCH_BITS).alias("stretch"), "*",
                       F.coalesce(number.bitwiseAND((1 << STRETCH_BITS) - 1), F.lit(0)).cast("int").alias("bit"))
    return rows.drop("issue_num").groupBy("repo", "stretch").applyInPandasWithState(
        _first_labels, "repo string, issue_num bigint, label string", "labelled string", "append", GroupStateTimeout.NoTimeout)


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One folder per batch, overwritten by a replay; a few files, however many tasks kept state."""
    batch.coalesce(SINK_FILES).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(repo, issue_num, label)`` of a stream's sink."""
    return spark.read.schema("repo string, issue_num bigint, label string, batch bigint").parquet(path).drop("batch")


def compact_labels(spark: SparkSession, path: str, to: str) -> None:
    """The sink's labels rewritten by repo, in files of a sensible size, for readers of many batches."""
    read_labels(spark, path).repartitionByRange("repo", "issue_num").write.mode("overwrite").partitionBy("repo").parquet(to)


def run_incremental(spark: SparkSession, source_path: str, sink_path: str, checkpoint_path: str,
                    as_of: float | Callable[[], float] | None, delta_seconds: float, scorer: Scorer = keyword_scorer,
                    names: Sequence[str | None] = LABEL_NAMES, include_pull_requests: bool = False,
                    max_files_per_trigger: int | None = None, interval: str | None = None,
                    stop_after: float | None = None) -> None:
    """Run the stream over every snapshot file not yet consumed.

    ``as_of`` is the clock: a fixed time (reruns are deterministic), a function that is called when
    the stream starts, or None for the time of each batch.  Without ``interval`` the stream stops
    when all files are consumed; with it, it runs on until ``stop_after`` seconds.
    """
    clock = F.current_timestamp().cast("double") if as_of is None else F.lit(float(as_of() if callable(as_of) else as_of))
    reader = spark.readStream.schema(SNAPSHOT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    labelled = labelled_stream(reader.parquet(source_path), clock, delta_seconds, scorer, names, include_pull_requests)
    writer = labelled.writeStream.outputMode("append").foreachBatch(lambda batch, i: write_batch(batch, i, sink_path)).option(
        "checkpointLocation", checkpoint_path)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    if interval and stop_after is not None:
        query.awaitTermination(stop_after)
        query.stop()
    else:
        query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def issue_snapshots(issues: DataFrame, labelled: DataFrame) -> DataFrame:
    """Snapshots in ``SNAPSHOT_SCHEMA`` from the issues view: an issue carries
    a label when its id is in ``labelled`` (``doc_id``, ``quality``); every
    tenth issue stands for a pull request."""
    lab = labelled.select(F.col("doc_id").alias("id"), F.concat(F.lit("quality-"), F.col("quality")).alias("_l"))
    joined = issues.join(lab, "id", "left")
    return joined.select(
        "repo", "id", "title", "body", "url", "updated_s",
        F.when(F.col("id") % 10 == 9, F.concat(F.col("url"), F.lit("/pull"))).alias("pull_request"),
        F.when(F.col("_l").isNull(), F.array().cast("array<string>")).otherwise(F.array("_l")).alias("label_names"))
