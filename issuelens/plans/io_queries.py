"""Catalog queries: dumps, specs, persisted tables, sinks, incremental labels.

Each query writes what Spark derives from the driver tables to a new folder
under the shared ``spark.checkpoint.dir`` and returns what it reads back, so
the SQL twin is the same relation computed without the round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedupe, evaluate, keyword, labels
from ..session import scratch_path
from ..sources import io, tables
from ..streaming import incremental as R
from . import common as C
from . import oracle as O
from .catalog import register
from .corpus_queries import KEPT_SQL, LOCAL_DEDUPE_CTES, local_issues
from .queries import _runs_sql, slices_of, _scored_tests

W = O.with_ctes
DUMP_COLS = ("repo", "id", "title", "body", "labels")
RECENT_SECONDS = 12 * 3600
NO_FILTER_REPO = "repo5"   # its scrape spec asks for no label filter (``[]``)


def _write_dump(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    io.write_issues_json(df.select(*DUMP_COLS), path)
    return path


def _repo_numbers(issues: DataFrame) -> DataFrame:
    """Issue numbers as the API gives them: counted per repo, so they repeat across repos."""
    number = (F.col("id") + 7 * F.substring("repo", 5, 9).cast("bigint")).cast("string")
    return issues.withColumn("url", F.concat(F.lit("https://api.example.com/repos/"), F.col("repo"), F.lit("/issues/"), number))


def _labelled_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"))


_WL = ", ".join(O.q(w) for w in labels.whitelist())
_LABELLER_X = O.clean(O.concat_features(trailing=False), R.T.LABELLER_STEPS)
_NAME_SQL = "case pred " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(R.LABEL_NAMES)) + " end"
_REPO_URL = "concat('https://api.example.com/repos/', repo, '/issues/', cast(id + 7 * cast(substr(repo, 5) as bigint) as varchar))"
_UNLABELLED = "not exists (select 1 from labels l where l.doc_id = i.id)"


# --- S1, S2, S5 ---------------------------------------------------------------------------

@register("scan_issues", "S1", W(O.base_ctes(), "select repo, id, title, body, labels from issues"))
def scan_issues(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_dump(spark, C.issues(spark, sf), "dump")
    return io.scan_issues(spark, path).select(*DUMP_COLS)


@register("scan_array_dumps", "S1", W(O.base_ctes(), "select repo, id, title, body, labels from issues"))
def scan_array_dumps(spark: SparkSession, sf: str) -> DataFrame:
    path = io.write_array_dumps(C.issues(spark, sf).select("title", "body", "labels", "id", "repo"), scratch_path(spark, "array-dump"))
    return io.scan_array_dumps(spark, path, repo_pattern=io.REPO_FROM_FOLDER).select(*DUMP_COLS)


@register("union_repos", "S2/U1", W(O.base_ctes(), """
select repo, id, title, body, labels,
  case when repo in ('repo0', 'repo1', 'repo2') then 'seen' else 'unseen' end as split
from issues"""))
def union_repos(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_dump(spark, C.issues(spark, sf), "dump")
    frames = [io.scan_issues(spark, f"{path}/repo={{{','.join(repos)}}}").withColumn("split", F.lit(s))
              for s, repos in (("seen", tables.SEEN_REPOS), ("unseen", tables.UNSEEN_REPOS))]
    return io.union_repos(frames).select(*DUMP_COLS, "split")


@register("write_issues_json", "S5", W(LOCAL_DEDUPE_CTES, f"select repo, id, title, body, labels {KEPT_SQL}"))
def write_issues_json(spark: SparkSession, sf: str) -> DataFrame:
    """The ``_removed_dups`` dump: issues without bad ids, written and re-read."""
    iss = local_issues(spark, sf)
    kept = dedupe.remove_duplicates(iss, dedupe.bad_ids(iss, labels.whitelist()))
    path = _write_dump(spark, kept, "removed_dups")
    return io.scan_issues(spark, path).select(*DUMP_COLS)


# --- S3, S4 --------------------------------------------------------------------------------

def _specs_frame(issues: DataFrame) -> DataFrame:
    """One spec per repo: the whitelisted labels it uses, sorted; ``[]`` for
    the repo that asks for no filter."""
    wl = labels.whitelist()
    per_repo = issues.groupBy("repo").agg(
        F.array_sort(F.collect_set(F.when(F.col("labels").isin(wl), F.col("labels")))).alias("desired_labels"))
    return per_repo.select("repo", F.when(F.col("repo") == NO_FILTER_REPO, F.array().cast("array<string>"))
                           .otherwise(F.col("desired_labels")).alias("desired_labels"))


def _write_specs(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "specs")
    _specs_frame(C.issues(spark, sf)).write.mode("overwrite").json(path)
    return path


@register("scrape_spec", "S3", W(O.base_ctes(), f"""
select distinct repo, labels as desired_label from issues where labels in ({_WL}) and repo <> '{NO_FILTER_REPO}'
union all select distinct repo, cast(null as varchar) from issues where repo = '{NO_FILTER_REPO}'"""))
def scrape_spec(spark: SparkSession, sf: str) -> DataFrame:
    return io.read_scrape_specs(spark, _write_specs(spark, sf))


def _raw_frame(issues: DataFrame) -> DataFrame:
    """Raw API-shaped issues: every tenth is a pull request; every fifth also
    carries a ``triage`` label; some carry no other label."""
    label_structs = F.filter(F.array(F.when(F.col("id") % 7 != 3, F.struct(F.col("labels").alias("name"))),
                                     F.when(F.col("id") % 5 == 0, F.struct(F.lit("triage").alias("name")))),
                             lambda x: x.isNotNull())
    return issues.select(
        "repo", "id", "title", "body", "url",
        F.when(F.col("id") % 10 == 9, F.struct(F.concat("url", F.lit("/pull")).alias("url"))).alias("pull_request"),
        label_structs.alias("labels"))


@register("normalise_dump", "S4", W(O.base_ctes(), f"""
select repo, id, title, body, labels from issues where id % 10 <> 9 and repo <> '{NO_FILTER_REPO}' and id % 7 <> 3 and labels in ({_WL})
union all select repo, id, title, body, cast(null as varchar) from issues where id % 10 <> 9 and repo = '{NO_FILTER_REPO}'"""))
def normalise_dump(spark: SparkSession, sf: str) -> DataFrame:
    raw_path = scratch_path(spark, "raw")
    _raw_frame(C.issues(spark, sf)).write.mode("overwrite").partitionBy("repo").json(raw_path)
    raw = io.scan_issues(spark, raw_path, schema=io.RAW_SCHEMA)
    specs = io.read_scrape_specs(spark, _write_specs(spark, sf))
    return io.normalise_dump(raw, specs)


# --- S6, S8 --------------------------------------------------------------------------------

_DS_COLS = ("id", "repo", "split", "label", "title", "body")


@register("dataset_roundtrip", "S6", W(C.ctes_dataset(), "select id, repo, split, label, title, body from ds"))
def dataset_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dataset")
    io.write_dataset(C.dataset(spark, sf).select(*_DS_COLS), path)
    return io.read_dataset(spark, path).select(*_DS_COLS)


def _report_sql() -> str:
    ctes, _ = _runs_sql(True)
    parts = [f"select run, split, slice, '{m}' as metric, cast({m} as double) as value from runs where run = 1"
             for m in evaluate.METRIC_COLUMNS]
    return W(ctes, " union all ".join(parts))


@register("metrics_report", "S8", _report_sql())
def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = slices_of(_scored_tests(spark, sf, seed=1))
    m = evaluate.classification_metrics(scored, by=["split", "slice"]).withColumn("run", F.lit(1))
    path = scratch_path(spark, "report")
    io.write_metrics_report(io.metrics_long(m, ["run", "split", "slice"], evaluate.METRIC_COLUMNS), path)
    return spark.read.parquet(path)


# --- P7, P8, S9, R1 ----------------------------------------------------------------------

@register("unlabelled_only", "P7", W(O.base_ctes(), f"select id, repo from issues i where {_UNLABELLED}"))
def unlabelled_only(spark: SparkSession, sf: str) -> DataFrame:
    return io.unlabelled_only(C.issues(spark, sf), _labelled_ids(spark, sf)).select("id", "repo")


def _as_of(issues: DataFrame) -> int:
    """The newest update time: one scalar aggregate (the run's clock)."""
    return int(issues.agg(F.max("updated_s")).first()[0])


@register("recent_since", "P8", W(O.base_ctes(), f"""
select id, updated_s from issues where updated_s >= (select max(updated_s) from issues) - {RECENT_SECONDS}"""))
def recent_since(spark: SparkSession, sf: str) -> DataFrame:
    iss = C.issues(spark, sf)
    return io.recent_since(iss, "updated_s", _as_of(iss), RECENT_SECONDS).select("id", "updated_s")


@register("label_sink", "S9", W(O.base_ctes(), f"""
select repo, issue_num, label from (
  select repo, {O.issue_number(_REPO_URL)} as issue_num, {_NAME_SQL} as label
  from (select id, repo, {O.keyword_pred(_LABELLER_X)} as pred from issues i where {_UNLABELLED}))
where label is not null"""))
def label_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Issue numbers repeat across repos here, as they do in reality."""
    todo = _repo_numbers(io.unlabelled_only(C.issues(spark, sf), _labelled_ids(spark, sf)))
    pred = keyword.keyword_classify(R.labeller_text())
    named = todo.select("repo", T.issue_number("url").alias("issue_num"), T.label_name(pred, R.LABEL_NAMES).alias("label"))
    path = scratch_path(spark, "labels_sink")
    io.append_labels(named, path)
    return io.read_sink(spark, path).drop("bucket")


@register("incremental_labelling", "R1", W(O.base_ctes(), f"""
select repo, issue_num, label from (
  select repo, {O.issue_number(_REPO_URL)} as issue_num, {_NAME_SQL} as label
  from (select id, repo, {O.keyword_pred(_LABELLER_X)} as pred from issues i
        where {_UNLABELLED} and id % 10 <> 9 and id % 11 <> 5
          and updated_s >= (select max(updated_s) from issues) - {RECENT_SECONDS}))
where label is not null"""))
def incremental_labelling(spark: SparkSession, sf: str) -> DataFrame:
    """Two stream runs: the first sees the even ids, the second the odd ids
    plus a later (edited) snapshot of every even id, which must be skipped.
    Some issues also have an earlier state or a later, labelled one in the same
    batch: only the latest counts.  Numbers repeat across repos."""
    snaps = R.issue_snapshots(_repo_numbers(C.issues(spark, sf)), tables.read_table(spark, sf, "labels"))
    named = snaps.filter(F.col("id") % 11 == 5).withColumn("updated_s", F.col("updated_s") + 2).withColumn(
        "label_names", F.array(F.lit("done")))
    early = snaps.filter(F.col("id") % 3 == 0).withColumn("updated_s", F.col("updated_s") - 1).withColumn("title", F.lit("panic"))
    snaps = snaps.unionByName(named).unionByName(early)
    as_of = _as_of(C.issues(spark, sf))
    source, sink, ckpt = (scratch_path(spark, n) for n in ("snapshots", "labels_sink", "stream_ckpt"))
    snaps.filter(F.col("id") % 2 == 0).write.mode("append").parquet(source)
    R.run_incremental(spark, source, sink, ckpt, as_of, RECENT_SECONDS)
    later = snaps.filter(F.col("id") % 2 == 0).withColumn("updated_s", F.col("updated_s") + 1)
    snaps.filter(F.col("id") % 2 == 1).unionByName(later).write.mode("append").parquet(source)
    R.run_incremental(spark, source, sink, ckpt, as_of, RECENT_SECONDS)
    return R.read_labels(spark, sink)
