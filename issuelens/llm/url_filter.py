"""URL filter: host rules first, else logistic regression on hashed character n-grams.

The classifier is trained on a small labelled URL table (``url_labels``, a few
hundred rows made from word lists), so its cost does not grow with the pages.
Features and scoring run inside the JVM: n-grams by regex lookahead, the hashing
trick and the linear model by ``pyspark.ml``.

Defined results: a null url or one without ``://`` has an empty host and path, no
rule, and the verdict ``allow`` (there is nothing to judge).  A url repeated in
several rows gets the same verdict in each; extra columns are not looked at.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (host, path prefix, verdict)
DEFAULT_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

# Word lists of the labelled table.
BLOCK_FIRST = ("casino", "spam", "cheap", "free", "adult", "ads", "poker", "xxx", "loan", "pills")
BLOCK_LAST = ("win", "farm", "pills", "bets", "track", "bonus", "cash", "slots", "meds", "clicks")
ALLOW_FIRST = ("city", "river", "open", "daily", "north", "green", "old", "data", "school", "music")
ALLOW_LAST = ("library", "museum", "news", "garden", "review", "letters", "works", "archive", "house", "notes")
SYLLABLES = ("ba", "ren", "tho", "lin", "mer", "os", "ta", "vel")
TOP = ("com", "org", "net")
PATHS = ("/en/12", "/fr/7/", "/de/305.html", "/es/41")


def url_labels(spark: SparkSession) -> DataFrame:
    """(url, block): labelled urls in equal numbers of paths and top domains for both classes."""
    rows = []
    for i, (a, b) in enumerate(product(BLOCK_FIRST, BLOCK_LAST)):
        rows.append((f"http://{a}-{b}.site.{TOP[i % 3]}{PATHS[i % 4]}", 1.0))
    for i, (a, b) in enumerate(product(ALLOW_FIRST, ALLOW_LAST)):
        rows.append((f"http://{a}-{b}.site.{TOP[i % 3]}{PATHS[i % 4]}", 0.0))
    for i, (a, b) in enumerate(product(SYLLABLES, SYLLABLES)):
        front = ("", "www.", "blog.", "m.")[(i // 3) % 4]
        rows.append((f"https://{front}{a}{b}.site.{TOP[i % 3]}{PATHS[(i // 2) % 4]}", 0.0))
    return spark.createDataFrame(rows, "url string, block double").coalesce(1)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=DEFAULT_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def ngrams(text: Column, tag: str, sizes=(3, 4)) -> Column:
    """All character n-grams with begin and end marks; ``tag`` keeps host and path apart."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    parts = [F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sizes]
    return F.transform(F.concat(*parts), lambda g: F.concat(F.lit(tag), g))


def with_grams(df: DataFrame, host: Column, path: Column) -> DataFrame:
    return df.withColumn("_grams", F.concat(ngrams(host, "h:"), ngrams(path, "p:")))


def train(labels: DataFrame, n_features: int = 1 << 16, reg: float = 0.002, max_iter: int = 40) -> PipelineModel:
    """Fit on labelled (url, block) rows."""
    data = with_grams(labels, host_of(F.col("url")), path_of(F.col("url")))
    return Pipeline(stages=[
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=n_features, binary=True),
        LogisticRegression(featuresCol="_tf", labelCol="block", probabilityCol="_prob", rawPredictionCol="_raw",
                           predictionCol="_pred", regParam=reg, maxIter=max_iter),
    ]).fit(data)


def judge_urls(pages: DataFrame, model: PipelineModel | None = None, rules=DEFAULT_RULES,
               threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``."""
    model = model or train(url_labels(pages.sparkSession))
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.transform(with_grams(base, F.col("host"), F.col("path")))
    rule, by_rule = longest_rule(F.col("host"), F.col("path"), rules)
    score = vector_to_array("_prob")[1]
    by_model = F.when((F.col("host") != "") & (score >= threshold), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(by_rule, by_model).alias("verdict"), score.alias("score"))
