"""Catalog queries: labels, predicates, cleaners, split, keyword model, metrics.

Each query pairs a Spark DataFrame with its SQL twin.  Outputs are keyed by
ids and use scalar columns (arrays are joined to text or exploded to long
form) so the two engines' results compare value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, keyword, labels, split
from . import common as C
from . import oracle as O
from .catalog import register

W = O.with_ctes
SPLITS = ("seen", "unseen")
SLICES = ("all", "code", "url", "log")


# --- flagship ------------------------------------------------------------------------

def _keyword_eval_sql(seed: int = C.SEED) -> str:
    ctes = C.ctes_test(seed) + [("sc", f"select split, label, {O.keyword_pred('X')} as pred from te")]
    mctes, body = O.metrics_body("sc", by=["split"])
    return W(ctes + mctes, body)


@register("keyword_evaluation", "M2", _keyword_eval_sql())
def keyword_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.keyword_evaluation(C.dataset(spark, sf), C.SHARE, C.SEED)


@register("keyword_classifier", "M1", W(C.ctes_dataset(), f"""
select id, cast({O.count(O.concat_features(), keyword.keyword_patterns()[0])} as integer) as n_bug,
  cast({O.count(O.concat_features(), keyword.keyword_patterns()[1])} as integer) as n_doc,
  cast({O.count(O.concat_features(), keyword.keyword_patterns()[2])} as integer) as n_feature,
  {O.keyword_pred(O.concat_features())} as pred,
  {O.keyword_pred(O.concat_features(), as_written=True)} as pred_as_written
from ds"""))
def keyword_classifier(spark: SparkSession, sf: str) -> DataFrame:
    x = T.concat_features()
    counts = keyword.keyword_scores(x)
    return C.dataset(spark, sf).select(
        "id", counts[0].alias("n_bug"), counts[1].alias("n_doc"), counts[2].alias("n_feature"),
        keyword.keyword_classify(x).alias("pred"),
        keyword.keyword_classify(x, as_written=True).alias("pred_as_written"))


# --- labels (P2-P6) -----------------------------------------------------------------

@register("standardise_labels", "P2/J4", W(O.base_ctes(), """
select i.id, i.repo, i.labels, cast(coalesce(m.label, -1) as integer) as label
from issues i left join lmap m on i.repo = m.repo and i.labels = m.raw_label"""))
def standardise_labels(spark: SparkSession, sf: str) -> DataFrame:
    out = labels.standardise_labels(C.issues(spark, sf), labels.label_map_frame(spark))
    return out.select("id", "repo", "labels", "label")


@register("remove_other_class", "P3", W(C.ctes_dataset(), "select id, repo, split, label from ds"))
def remove_other_class(spark: SparkSession, sf: str) -> DataFrame:
    return C.dataset(spark, sf).select("id", "repo", "split", "label")


def _whitelist_sql() -> str:
    wl = ", ".join(O.q(w) for w in labels.whitelist())
    return W(O.base_ctes(), f"select id, repo, labels from issues where labels in ({wl})")


@register("whitelist_labels", "P4/U3", _whitelist_sql())
def whitelist_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.whitelist_labels(C.issues(spark, sf), labels.whitelist()).select("id", "repo", "labels")


@register("concat_features", "P5", W(O.base_ctes(), f"""
select id, {O.concat_features()} as X, {O.concat_features(trailing=False)} as X_labeller from issues"""))
def concat_features(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select("id", T.concat_features().alias("X"),
                                      T.concat_features(trailing=False).alias("X_labeller"))


@register("project_columns", "P6", W(O.base_ctes(), "select body, title, labels, id from issues"))
def project_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select("body", "title", "labels", "id")


@register("issue_number", "P9", W(O.base_ctes(), f"select id, {O.issue_number('url')} as issue_num from issues"))
def issue_number(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select("id", T.issue_number("url").alias("issue_num"))


# --- predicates (P10-P13) -------------------------------------------------------------

_X = O.concat_features()


@register("has_log", "P10", W(O.base_ctes(), f"""
select id, {O.has_log(_X)} as has_log, {O.has_log(_X, as_written=False)} as has_log_intended from issues"""))
def has_log(spark: SparkSession, sf: str) -> DataFrame:
    x = T.concat_features()
    return C.issues(spark, sf).select("id", T.has_log(x).alias("has_log"),
                                      T.has_log(x, as_written=False).alias("has_log_intended"))


@register("has_code_block", "P11", W(O.base_ctes(), f"select id, {O.has_code_block(_X)} as has_code from issues"))
def has_code_block(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select("id", T.has_code_block(T.concat_features()).alias("has_code"))


@register("has_url", "P12", W(O.base_ctes(), f"select id, {O.has_url(_X)} as has_url from issues"))
def has_url(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select("id", T.has_url(T.concat_features()).alias("has_url"))


def slices_of(df: DataFrame) -> DataFrame:
    """One row per (row, slice) the row belongs to; 'all' always."""
    tags = F.array(F.lit("all"), F.when(T.has_code_block("X"), F.lit("code")),
                   F.when(T.has_url("X"), F.lit("url")), F.when(T.has_log("X"), F.lit("log")))
    return df.withColumn("slice", F.explode(F.filter(tags, lambda s: s.isNotNull())))


def _slices_sql_cte(src: str = "te") -> str:
    return (f"select *, unnest(list_filter(['all', case when {O.has_code_block('X')} then 'code' end, "
            f"case when {O.has_url('X')} then 'url' end, case when {O.has_log('X')} then 'log' end], "
            f"lambda s: s is not null)) as slice from {src}")


@register("content_slices", "P13", W(C.ctes_test() + [("sl", _slices_sql_cte())],
                                      "select split, id, slice from sl"))
def content_slices(spark: SparkSession, sf: str) -> DataFrame:
    return slices_of(C.test_sets(spark, sf)).select("split", "id", "slice")


def _slice_grid(spark: SparkSession) -> DataFrame:
    rows = [(s, sl) for s in SPLITS for sl in SLICES]
    return spark.createDataFrame(rows, "split STRING, slice STRING")


@register("slice_sizes", "A13", W(C.ctes_test() + [("sl", _slices_sql_cte())], f"""
select g.split, g.slice, cast(count(sl.id) as bigint) as n
from (select * from (values {', '.join(f"('{s}', '{x}')" for s in SPLITS for x in SLICES)}) t(split, slice)) g
left join sl on sl.split = g.split and sl.slice = g.slice group by all"""))
def slice_sizes(spark: SparkSession, sf: str) -> DataFrame:
    counts = slices_of(C.test_sets(spark, sf)).groupBy("split", "slice").agg(F.count(F.lit(1)).alias("n"))
    return (_slice_grid(spark).join(counts, ["split", "slice"], "left")
            .select("split", "slice", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


@register("test_mode_head", "P14", W(C.ctes_dataset(), """
select split, id from (
  select split, id, row_number() over (partition by split order by md5(concat_ws('-', cast(id as varchar), '1'))) as rn
  from ds) where rn <= 50"""))
def test_mode_head(spark: SparkSession, sf: str) -> DataFrame:
    ds = C.dataset(spark, sf)
    parts = [split.first_rows(ds.filter(F.col("split") == s), 50, C.SEED).select("split", "id") for s in SPLITS]
    return parts[0].unionByName(parts[1])


# --- shuffle and split (T4, T5) ----------------------------------------------------

@register("seeded_shuffle", "T4", W(C.ctes_dataset(), """
select split, id, md5(concat_ws('-', cast(id as varchar), '1')) as shuffle_key from ds"""))
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return C.dataset(spark, sf).select("split", "id", split.shuffle_key(F.col("id"), C.SEED).alias("shuffle_key"))


@register("train_test_split", "T5", W(C.ctes_flagged(), "select split, id, is_train from fl"))
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.flagged(spark, sf).select("split", "id", "is_train")


# --- cleaners (F1-F7) ------------------------------------------------------------------

@register("remove_code_block", "F1", W(O.base_ctes(), f"select id, {O.remove_code_block(_X)} as text from issues"))
def remove_code_block(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select("id", T.remove_code_block(T.concat_features()).alias("text"))


@register("remove_log", "F2", W(O.base_ctes(), f"""
select id, {O.remove_log(_X)} as text, {O.remove_log(_X, as_written=False)} as text_intended from issues"""))
def remove_log(spark: SparkSession, sf: str) -> DataFrame:
    x = T.concat_features()
    return C.issues(spark, sf).select("id", T.remove_log(x).alias("text"),
                                      T.remove_log(x, as_written=False).alias("text_intended"))


@register("remove_url", "F3", W(O.base_ctes(), f"select id, {O.remove_url(_X)} as text from issues"))
def remove_url(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select("id", T.remove_url(T.concat_features()).alias("text"))


@register("remove_markdown", "F4", W(O.base_ctes(), f"select id, {O.remove_markdown(_X)} as text from issues"))
def remove_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select("id", T.remove_markdown(T.concat_features()).alias("text"))


@register("clean_text", "F5", W(O.base_ctes(), f"""
select id, {O.clean(_X, T.TRAINER_STEPS)} as trainer_text,
  {O.clean(O.concat_features(trailing=False), T.LABELLER_STEPS)} as labeller_text from issues"""))
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select(
        "id", T.clean(T.concat_features(), T.TRAINER_STEPS).alias("trainer_text"),
        T.clean(T.concat_features(trailing=False), T.LABELLER_STEPS).alias("labeller_text"))


@register("sequence_features", "F6", W(C.ctes_dataset(), f"""
select id, {O.remove_markdown('title')} as title, {O.remove_markdown('body')} as text, label from ds"""))
def sequence_features(spark: SparkSession, sf: str) -> DataFrame:
    return C.dataset(spark, sf).select("id", T.remove_markdown("title").alias("title"),
                                       T.remove_markdown("body").alias("text"), "label")


_SEP = "\n<<>>\n"


@register("split_code_text", "F7", W(O.base_ctes(), f"""
select id, cast(len({O.code_blocks('body')}) as integer) as n_codeblocks,
  array_to_string({O.code_blocks('body')}, {O.q(_SEP)}) as codeblocks,
  {O.replace_all('body', T.P.FENCE, '')} as text, title, labels from issues"""))
def split_code_text(spark: SparkSession, sf: str) -> DataFrame:
    s = T.split_code_text("body")
    return C.issues(spark, sf).select(
        "id", F.size(s["codeblocks"]).alias("n_codeblocks"),
        F.array_join(s["codeblocks"], _SEP).alias("codeblocks"), s["text"].alias("text"), "title", "labels")


# --- metrics (A3-A7, A8-A10, M10, M11) -----------------------------------------------

def _scored_tests(spark: SparkSession, sf: str, seed: int = C.SEED) -> DataFrame:
    return C.test_sets(spark, sf, seed).withColumn("pred", keyword.keyword_classify(F.col("X")))


def _scored_sql(seed: int = C.SEED) -> list[tuple[str, str]]:
    return C.ctes_test(seed) + [("sc", f"select *, {O.keyword_pred('X')} as pred from te")]


def _metric_sql(cols: str, by=("split",)) -> str:
    mctes, body = O.metrics_body("sc", by=list(by))
    return W(_scored_sql() + mctes + [("mm", body)], f"select {cols} from mm")


@register("accuracy_labelled", "A3", _metric_sql("split, n_labelled, n_correct, n_pred_doc, accuracy"))
def accuracy_labelled(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.classification_metrics(_scored_tests(spark, sf), by=["split"])
    return m.select("split", "n_labelled", "n_correct", "n_pred_doc", "accuracy")


@register("weighted_prf", "A4", _metric_sql("split, precision, recall, fscore"))
def weighted_prf(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.classification_metrics(_scored_tests(spark, sf), by=["split"])
    return m.select("split", "precision", "recall", "fscore")


@register("plain_accuracy", "A5", W(_scored_sql(), """
select split, count(*) as n_rows, round(avg(case when label = pred then 1.0 else 0.0 end), 6) as accuracy
from sc group by split"""))
def plain_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.plain_accuracy(_scored_tests(spark, sf), by=["split"])


@register("confusion_matrix", "A6", W(_scored_sql(), """
select g.split, g.truth,
  cast(count(case when s.pred = 0 then 1 end) as bigint) as pred_0,
  cast(count(case when s.pred = 1 then 1 end) as bigint) as pred_1,
  cast(count(case when s.pred = 2 then 1 end) as bigint) as pred_2,
  cast(count(case when s.pred = -1 then 1 end) as bigint) as pred_m1
from (select distinct split, unnest([0, 1, 2]) as truth from sc) g
left join sc s on s.split = g.split and s.label = g.truth group by all"""))
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_matrix(_scored_tests(spark, sf), by=["split"])


RUNS = (0, 1, 2)


def _runs_spark(spark: SparkSession, sf: str, by_slice: bool) -> DataFrame:
    """Metrics of all runs in one pass: the prediction does not depend on the seed, so
    every issue is scored once and then counted in the runs that test it."""
    ds = C.dataset(spark, sf)
    for run in RUNS:
        ds = split.with_train_flag(ds, C.SHARE, run, group_col="split", groups=("seen",), flag=f"_train{run}")
    tested = F.array_compact(F.array(*[F.when(~F.col(f"_train{run}"), F.lit(run)) for run in RUNS]))
    scored = (ds.withColumn("_runs", tested).filter(F.size("_runs") > 0)
              .withColumn("X", T.concat_features()).withColumn("pred", keyword.keyword_classify(F.col("X"))))
    if by_slice:
        scored = slices_of(scored)
    by = ["split", "slice"] if by_slice else ["split"]
    scored = scored.select(*by, "label", "pred", F.explode("_runs").alias("run"))
    return evaluate.classification_metrics(scored, by=[*by, "run"])


def _runs_sql(by_slice: bool) -> str:
    selects = []
    ctes: list[tuple[str, str]] = O.base_ctes() + [("ds", O.dataset_cte())]
    by = ["split", "slice"] if by_slice else ["split"]
    for run in RUNS:
        ctes += [(f"fl{run}", O.flagged_cte("ds", C.SHARE, run)),
                 (f"te{run}", f"select *, {O.concat_features()} as X from fl{run} where not is_train"),
                 (f"sc{run}", f"select *, {O.keyword_pred('X')} as pred from te{run}")]
        src = f"sc{run}"
        if by_slice:
            ctes.append((f"sl{run}", _slices_sql_cte(src)))
            src = f"sl{run}"
        mctes, body = O.metrics_body(src, by=by)
        mctes = [(f"{n}{run}", s.replace("m_cells", f"m_cells{run}").replace("m_side", f"m_side{run}")
                  .replace("m_per", f"m_per{run}").replace("m_prf", f"m_prf{run}").replace("m_f1", f"m_f1{run}"))
                 for n, s in mctes]
        body = body.replace("m_f1", f"m_f1{run}")
        ctes += mctes + [(f"mm{run}", body)]
        selects.append(f"select *, {run} as run from mm{run}")
    ctes.append(("runs", " union all ".join(selects)))
    return ctes, by


def _avg_sql(by_slice: bool) -> str:
    ctes, by = _runs_sql(by_slice)
    keys = ", ".join(by)
    metrics = ", ".join(f"round(avg(cast({c} as double)), 6) as {c}" for c in evaluate.METRIC_COLUMNS)
    return W(ctes, f"select {keys}, {metrics} from runs group by {keys}")


def _sliced_sql() -> str:
    ctes, _ = _runs_sql(True)
    return W(ctes, "select * from runs where run = 1")


@register("sliced_evaluation", "M10", _sliced_sql())
def sliced_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    scored = slices_of(_scored_tests(spark, sf, seed=1))
    return evaluate.classification_metrics(scored, by=["split", "slice"]).withColumn("run", F.lit(1))


@register("repeat_average", "M11", _avg_sql(True))
def repeat_average(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.average_results(_runs_spark(spark, sf, by_slice=True), ["split", "slice"])


@register("average_results", "A7", _avg_sql(False))
def average_results(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.average_results(_runs_spark(spark, sf, by_slice=False), ["split"])


@register("repo_counts", "A8", W(O.base_ctes(), "select repo, count(*) as n from issues group by repo"))
def repo_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@register("class_profile", "A9", W(C.ctes_dataset(), """
select split, repo, n_feature, n_bug, n_doc, n_total,
  round(n_feature / n_total, 6) as share_feature, round(n_bug / n_total, 6) as share_bug,
  round(n_doc / n_total, 6) as share_doc
from (select split, repo, count(*) filter (where label = 0) as n_feature,
        count(*) filter (where label = 1) as n_bug, count(*) filter (where label = 2) as n_doc,
        count(*) as n_total
      from ds group by rollup(split, repo))"""))
def class_profile(spark: SparkSession, sf: str) -> DataFrame:
    agg = C.dataset(spark, sf).rollup("split", "repo").agg(
        F.count_if(F.col("label") == 0).alias("n_feature"), F.count_if(F.col("label") == 1).alias("n_bug"),
        F.count_if(F.col("label") == 2).alias("n_doc"), F.count(F.lit(1)).alias("n_total"))
    return agg.select("split", "repo", "n_feature", "n_bug", "n_doc", "n_total", *[
        F.round(F.col(f"n_{c}") / F.col("n_total"), 6).alias(f"share_{c}") for c in ("feature", "bug", "doc")])


@register("machine_info_share", "A10", W(C.ctes_dataset() + [("dx", f"select *, {_X} as X from ds")], f"""
select split, round(avg(case when {O.has_url('X')} then 1.0 else 0.0 end), 6) as share_url,
  round(avg(case when {O.has_code_block('X')} then 1.0 else 0.0 end), 6) as share_code,
  round(avg(case when {O.has_log('X')} then 1.0 else 0.0 end), 6) as share_log
from dx group by split"""))
def machine_info_share(spark: SparkSession, sf: str) -> DataFrame:
    x = T.concat_features()
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return C.dataset(spark, sf).groupBy("split").agg(
        share(T.has_url(x)).alias("share_url"), share(T.has_code_block(x)).alias("share_code"),
        share(T.has_log(x)).alias("share_log"))
