"""Physical-plan properties: no hidden reshuffles, no text in exchanges, column pruning."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from issuelens.operators import vectors
from issuelens.sources import tables


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_scans_are_not_reshuffled_unless_asked(spark, sf_small):
    asked = spark.conf.get(tables.SPREAD_SETTING)
    spark.conf.unset(tables.SPREAD_SETTING)
    try:
        assert "RoundRobin" not in _plan(tables.read_table(spark, sf_small, "documents"))
    finally:
        spark.conf.set(tables.SPREAD_SETTING, asked)
    assert "RoundRobin" in _plan(tables.read_table(spark, sf_small, "documents"))


def test_vector_plans_shuffle_no_text(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumnRenamed("doc_id", "id")
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    shape = vectors.table_shape(emb)
    for f in (vectors.normalised_vector_mean, vectors.sentence_vector_mean, vectors.text_mean_vector):
        outputs = _exchange_outputs(f(docs, F.col("text"), emb, *shape))
        assert outputs and not any({"text", "_s", "_tok"} & o for o in outputs)


def _exchange_outputs(df) -> list[set]:
    found, todo = [], [df._jdf.queryExecution().sparkPlan(), df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Exchange":
            out = node.output()
            found.append({out.apply(i).name() for i in range(out.size())})
    return found


def test_every_vector_can_be_hit(spark):
    words = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
    hit = words.select(vectors.word_vector_id(F.col("w"), 2 * 1500).alias("v")).filter("v < 1500")
    assert hit.distinct().count() == 1500


def test_repeated_runs_are_scored_once(spark, sf_small):
    import importlib
    q = importlib.import_module("__spark_entry__").queries()
    assert _plan(q["repeat_average"](spark, sf_small)).count("ReadSchema") == 1


def test_queries_leave_nothing_cached(spark, sf_small):
    import importlib
    q = importlib.import_module("__spark_entry__").queries()
    spark.catalog.clearCache()
    for key in ("bad_ids", "remove_duplicates", "duplicate_groups"):
        q[key](spark, sf_small).collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_flagship_scan_prunes_columns(spark, sf_small):
    import importlib
    plan = _plan(importlib.import_module("__spark_entry__").entry(spark))
    schemas = [l for l in plan.splitlines() if l.startswith("ReadSchema")]
    assert schemas and all("lang" not in s and "n_chars" not in s for s in schemas)
    assert any("text" in s for s in schemas)


def test_results_do_not_depend_on_partitioning(spark, sf_small):
    import importlib
    q = importlib.import_module("__spark_entry__").queries()
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    out = {}
    try:
        for parts in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out[parts] = {k: sorted(map(tuple, q[k](spark, sf_small).collect()))
                          for k in ("keyword_evaluation", "top_words_per_class", "bad_ids")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert out["1"] == out["16"]


def test_every_keyword_pattern_is_counted_once(spark):
    """The decision reads the scores several times; the plan holds one count of each pattern."""
    from issuelens.functions import text as T
    from issuelens.operators import keyword
    texts = spark.range(5).select(F.concat(F.lit("bug "), F.col("id")).alias("X"))
    plans = [texts.select(keyword.keyword_classify(F.col("X"))),
             texts.select(T.softmax(keyword.keyword_scores(F.col("X")).cast("array<double>"))),
             texts.select(T.decode(keyword.keyword_scores(F.col("X")).cast("array<double>"), 0.5, strict=False))]
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_count") == len(keyword.KEYWORD_LISTS)
