"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs fully (``noop`` sink, nothing collected) once to warm up and
then ``$BENCH_REPEATS`` times; the per-query figure is the median.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "keyword_evaluation", "sliced_evaluation", "clean_text", "handcrafted_features",
    "bad_ids", "top_words_per_class", "word_count_vector", "normalised_vector_mean",
    "nan_mean_vector", "train_test_split", "threshold_sweep", "class_profile",
)


def extras(spark, sf_dir: str) -> dict[str, float]:
    """One run each: text-model fit (M8), its scoring rate over the test rows, and the two stream runs of R1."""
    from issuelens.plans import model_queries
    from issuelens.plans.catalog import entries

    t0 = time.perf_counter()
    model, test = model_queries.fit_sequence(spark, sf_dir, run=1)
    fit = time.perf_counter() - t0
    rows = test.count()
    t0 = time.perf_counter()
    model.transform(test).select("id", "prediction").write.format("noop").mode("overwrite").save()
    rate = rows / (time.perf_counter() - t0)
    t0 = time.perf_counter()
    entries()["incremental_labelling"].query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return {"text_model_fit_sec": round(fit, 3), "text_model_rows_per_sec": round(rate, 1),
            "stream_sec": round(time.perf_counter() - t0, 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from issuelens.plans.catalog import entries
    from issuelens.session import build_session
    from issuelens.sources.tables import SPREAD_SETTING

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.conf.set(SPREAD_SETTING, cpus)  # the tables are files of one row group
    cat = entries()
    times: dict[str, float] = {}
    for key in HEADLINE:
        q = cat[key].query
        runs = []
        for i in range(repeats + 1):
            t0 = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(runs), 3)
    extra = extras(spark, sf_dir)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "extra": extra}))
    spark.stop()


if __name__ == "__main__":
    main()
