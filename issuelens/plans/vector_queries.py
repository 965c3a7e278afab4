"""Catalog queries: word vectors, scores and their decoding, threshold sweep.

The ``embeddings`` table is the word-vector table: a word's vector id is the first
15 hex digits of its md5, modulo twice the number of vectors.  Scores are the
keyword hits of the held-out issues, with their label as truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import evaluate, keyword, vectors
from ..operators.models import THRESHOLDS
from ..sources import tables
from ..streaming.incremental import LABEL_NAMES
from . import common as C
from . import oracle as O
from .catalog import register
from .corpus_queries import _sentences_sql, handcrafted_frame, handcrafted_values_sql

W = O.with_ctes
LOGIT_CONFIDENCE = 2


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, sf, "embeddings")


# --- SQL pieces -----------------------------------------------------------------------

def _vec_id_sql(tok: str) -> str:
    return f"(cast('0x' || substr(md5({tok}), 1, 15) as bigint) % (select 2 * count(*) from embeddings))"


_NORM = ("nv", "select vec_id, case when nrm > 0 then list_transform(e, lambda x: x / nrm) else e end as vec "
               "from (select vec_id, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) as nrm "
               "from (select vec_id, cast(embedding as double[]) as e from embeddings))")
_RAW = ("rv", "select vec_id, cast(embedding as double[]) as vec from embeddings")
_DIM = ("dm", "select max(len(embedding)) as d from embeddings")


def _mean_ctes(prefix: str, src: str, ids: str, text: str, vec_table: str) -> list[tuple[str, str]]:
    """Weighted mean of known token vectors per ``ids`` of ``src``."""
    return [
        (f"{prefix}_hits", f"select {ids}, {_vec_id_sql('tok')} as vec_id, count(*) as w from "
                           f"(select {ids}, unnest({O.extract_all(text, P.VECTOR_TOKEN)}) as tok from {src}) group by all"),
        (f"{prefix}_el", f"select {ids}, w, unnest(range(len(vec))) as dim, unnest(vec) as x "
                         f"from {prefix}_hits join {vec_table} using (vec_id)"),
        (f"{prefix}_mean", f"select {ids}, dim, sum(w * x) / sum(w) as value from {prefix}_el group by all"),
    ]


def _long_select(ids_src: str, mean: str, id_col: str = "id", extra: str = "") -> str:
    return (f"select g.{id_col}{extra}, cast(g.dim as integer) as dim, round(coalesce(m.value, 0.0), 6) as value "
            f"from (select {id_col}, unnest(range((select d from dm))) as dim from {ids_src}) g "
            f"left join {mean} m on m.{id_col} = g.{id_col} and m.dim = g.dim")


# --- vectors (J7, A14, A15, M5, J2, J3, F13) --------------------------------------------

@register("embedding_lookup", "J7", W(C.ctes_dataset() + [_NORM] + _mean_ctes("b", "ds", "id", "body", "nv")[:1], f"""
select d.id, cast(len({O.extract_all('d.body', P.VECTOR_TOKEN)}) as integer) as n_tokens,
  cast(coalesce(k.n_known, 0) as bigint) as n_known
from ds d left join (select id, sum(w) as n_known from b_hits where vec_id in (select vec_id from nv) group by id) k
  on d.id = k.id"""))
def embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ds = C.dataset(spark, sf)
    emb = _emb(spark, sf)
    hits = vectors.lookup(ds, F.col("body"), ["id"], vectors.vector_table(emb, True), vectors.table_shape(emb)[1])
    known = hits.groupBy("id").agg(F.count(F.lit(1)).alias("n_known"))
    return (ds.select("id", F.size(T.vector_tokens("body")).alias("n_tokens")).join(known, "id", "left")
            .select("id", "n_tokens", F.coalesce("n_known", F.lit(0)).cast("bigint").alias("n_known")))


@register("normalised_vector_mean", "A14", W(C.ctes_dataset() + [_NORM, _DIM] + _mean_ctes("b", "ds", "id", "body", "nv"),
                                              _long_select("ds", "b_mean")))
def normalised_vector_mean(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf)
    v = vectors.normalised_vector_mean(C.dataset(spark, sf), F.col("body"), emb, *vectors.table_shape(emb))
    return vectors.long_form(v, "vector", ["id"])


def _sentence_ctes(src: str, text: str, prefix: str) -> list[tuple[str, str]]:
    sents = (f"{prefix}_s", f"select id, unnest(range(len(s))) as sid, unnest(s) as sent from "
                            f"(select id, {_sentences_sql(text)} as s from {src})")
    inner = _mean_ctes(f"{prefix}_sv", f"{prefix}_s", "id, sid", "sent", "rv")
    para = (f"{prefix}_mean", f"select id, dim, avg(value) as value from {prefix}_sv_mean group by id, dim")
    return [sents] + inner + [para]


@register("nan_mean_vector", "A15", W(C.ctes_dataset() + [_RAW, _DIM] + _sentence_ctes("ds", O.remove_markdown("body"), "p"),
                                       _long_select("ds", "p_mean")))
def nan_mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf)
    v = vectors.sentence_vector_mean(C.dataset(spark, sf), T.remove_markdown("body"), emb, *vectors.table_shape(emb))
    return vectors.long_form(v, "vector", ["id"])


@register("sentence_embeddings", "M5", W(
    C.ctes_dataset() + [_RAW, _DIM] + _sentence_ctes("ds", O.remove_markdown("body"), "p")
    + [("tds", f"select id, {O.remove_markdown('title')} as t from ds")] + _mean_ctes("t", "tds", "id", "t", "rv"),
    _long_select("ds", "p_mean", extra=", 'body' as part") + " union all "
    + _long_select("ds", "t_mean", extra=", 'title' as part")))
def sentence_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf)
    shape = vectors.table_shape(emb)
    ds = C.dataset(spark, sf)
    body = vectors.sentence_vector_mean(ds, T.remove_markdown("body"), emb, *shape).withColumn("part", F.lit("body"))
    title = vectors.text_mean_vector(ds, T.remove_markdown("title"), emb, *shape).withColumn("part", F.lit("title"))
    return vectors.long_form(body.unionByName(title), "vector", ["id", "part"])


@register("combine_features", "J2", W(
    C.ctes_dataset() + [_NORM, _DIM] + _mean_ctes("b", "ds", "id", "body", "nv") + _mean_ctes("t", "ds", "id", "title", "nv")
    + [("bl", _long_select("ds", "b_mean")), ("tl", _long_select("ds", "t_mean"))],
    "select id, dim as pos, value from bl union all select id, cast(dim + (select d from dm) as integer) as pos, value from tl"))
def combine_features(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf)
    shape = vectors.table_shape(emb)
    ds = C.dataset(spark, sf)
    body = vectors.normalised_vector_mean(ds, F.col("body"), emb, *shape).withColumnRenamed("vector", "b")
    title = vectors.normalised_vector_mean(ds, F.col("title"), emb, *shape).withColumnRenamed("vector", "t")
    both = body.join(title, "id", "inner").select("id", F.concat("b", "t").alias("features"))
    return vectors.long_form(both, "features", ["id"]).withColumnRenamed("dim", "pos")


@register("cast_features", "J3", W(C.ctes_dataset(), f"""
select id, label, cast(pos as integer) as pos, cast(v as double) as value from (
  select id, label, unnest(range(13)) as pos, unnest([{', '.join(handcrafted_values_sql())}]) as v from ds)"""))
def cast_features(spark: SparkSession, sf: str) -> DataFrame:
    f = handcrafted_frame(spark, sf).withColumn("features", F.col("features").cast("array<double>"))
    return (f.select("id", "label", F.posexplode("features").alias("pos", "value")))


@register("l2_normalise", "F13", W([_NORM], """
select vec_id, cast(dim as integer) as dim, round(x, 6) as value
from (select vec_id, unnest(range(len(vec))) as dim, unnest(vec) as x from nv)"""))
def l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    t = vectors.vector_table(_emb(spark, sf), normalise=True)
    return vectors.long_form(t, "vec", ["vec_id"])


# --- scores of the held-out issues (T7, F14-F17, M9) -------------------------------------

def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, label, s)``: keyword hits [bug, doc, feature] of every test issue's whole text."""
    te = C.test_sets(spark, sf)
    return te.select("id", "label", keyword.keyword_scores(F.col("X")).cast("array<double>").alias("s"))


_SC = C.ctes_test() + [("sc0", "select id, label, cast([" + ", ".join(
    O.count("X", p) for p in keyword.keyword_patterns()) + "] as double[]) as s from te")]
_SM = _SC + [("smx", "select *, list_transform(s, lambda x: exp(x - list_max(s)) / list_sum(list_transform(s, lambda y: exp(y - list_max(s))))) as p from sc0")]


def _argmax_sql(s: str) -> str:
    return f"cast(list_position({s}, list_max({s})) - 1 as integer)"


def _decode_sql(s: str, t: float, strict: bool) -> str:
    op = ">" if strict else ">="
    return f"(case when list_max({s}) {op} {t} then {_argmax_sql(s)} else -1 end)"


@register("argmax_class", "T7", W(_SC, f"select id, {_argmax_sql('s')} as pred from sc0"))
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("id", T.argmax("s").alias("pred"))


@register("softmax", "F14", W(_SM, """
select id, round(p[1], 6) as p0, round(p[2], 6) as p1, round(p[3], 6) as p2,
  round(list_transform(p, lambda x: exp(x - list_max(p)) / list_sum(list_transform(p, lambda y: exp(y - list_max(p)))))[1], 6) as p0_double
from smx"""))
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    p = T.softmax("s")
    return _scored(spark, sf).select("id", *[F.round(p[i], 6).alias(f"p{i}") for i in range(3)],
                                     F.round(T.double_softmax("s")[0], 6).alias("p0_double"))


@register("decode_logits", "F15", W(_SC, f"""
select id, {_decode_sql('s', -10, True)} as pred_argmax, {_decode_sql('s', LOGIT_CONFIDENCE, True)} as pred from sc0"""))
def decode_logits(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("id", T.decode("s", -10, True).alias("pred_argmax"),
                                     T.decode("s", LOGIT_CONFIDENCE, True).alias("pred"))


@register("decode_probabilities", "F16", W(_SM, "select id, " + ", ".join(
    f"{_decode_sql('p', t, False)} as pred_{str(t).replace('.', '')}" for t in THRESHOLDS) + " from smx"))
def decode_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    p = _scored(spark, sf).select("id", T.softmax("s").alias("p"))
    return p.select("id", *[T.decode("p", t, False).alias(f"pred_{str(t).replace('.', '')}") for t in THRESHOLDS])


@register("label_name", "F17", W(_SC, f"""
select id, case {_decode_sql('s', LOGIT_CONFIDENCE, True)} """ + " ".join(
    f"when {i} then '{n}'" for i, n in enumerate(LABEL_NAMES)) + " end as label_name from sc0"))
def label_name(spark: SparkSession, sf: str) -> DataFrame:
    pred = T.decode("s", LOGIT_CONFIDENCE, True)
    return _scored(spark, sf).select("id", T.label_name(pred, LABEL_NAMES).alias("label_name"))


def _sweep_sql() -> str:
    th = ", ".join(str(t) for t in THRESHOLDS)
    src = ("sw", f"select cast(t as double) as threshold, label, {_decode_sql('p', 't', False)} as pred from smx, unnest([{th}]::double[]) u(t)")
    mctes, body = O.metrics_body("sw", by=["threshold"])
    return W(_SM + [src] + mctes, body)


@register("threshold_sweep", "M9", _sweep_sql())
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).select("label", T.softmax("s").alias("p"))
    swept = rows.select("label", "p", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold"))
    passed = F.array_max("p") >= F.col("threshold")
    swept = swept.withColumn("pred", F.when(passed, T.argmax("p")).otherwise(F.lit(-1)))
    return evaluate.classification_metrics(swept, "label", "pred", by=["threshold"])
