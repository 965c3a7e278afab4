"""Quality rules with thresholds that adapt to language and source.

Every document gets counts (words, characters in words, symbols, repeated lines,
words in repeated five-word windows).  Two fixed base rules reject the shortest
and the most repetitive texts.  The remaining verdict has no fixed cutoff: each
ratio below is summarised per language and source by a mergeable quantile sketch
(counts in logarithmic buckets, relative error ``ERROR``).  A group's quantiles are averaged with
those of its language's merged sketch, and these with those of all rows, by
n / (n + ``PRIOR_ROWS``), so small groups lean on the larger ones and no row more or less
switches thresholds.  A document is rejected if a ratio lies far outside the bulk of its own group.

Everything is DataFrame functions: no Python runs on the executors.  The counts
are computed once and stored; sketches are grouped counts, so a source with a
third of all rows reaches the shuffle as a few hundred rows per task.

Defined results: a null, empty or blank text has no words and fails the base rule;
null languages and sources form groups of their own; equal rows get equal
verdicts; an empty table gives an empty result; extra columns can be kept with
``columns``.  Windows are compared by 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ERROR = 0.02                    # relative error of the sketch
GAMMA = (1 + ERROR) / (1 - ERROR)
TINY = 0.001                    # ratios up to this share the lowest bucket
PRIOR_ROWS = 50                 # a group's quantiles are drawn to its language's as if it had this many rows of them

# ratio: (least spread counted, rejected above, rejected below)
RATIOS = {
    "symbol_ratio": (0.01, True, False),
    "chars_per_word": (0.5, True, True),
    "upper_ratio": (0.03, True, False),
    "mark_ratio": (0.03, True, False),
    "dup_line_ratio": (0.05, True, False),
    "repeat_ratio": (0.04, True, False),
}
FENCE = 5.0                     # spreads from the median to the fence


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` plus the counts and ratios of every whole text (no shuffle)."""
    w, h, s, p, n_up, n_mark = "_w", "_h", "_s", "_p", "_up", "_mark"
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = docs.withColumn(w, words_of(F.col("text")))
    d = d.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    last = F.size(F.col(w)) - WINDOW
    d = d.withColumn(h, F.when(last >= 0, F.transform(
        F.slice(F.col(h), 1, F.greatest(last + 1, F.lit(1))),
        lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, WINDOW)]))))
    # Only texts with a repeated window are sorted: (hash, position), then neighbours are compared.
    d = d.withColumn(s, F.when(F.size(F.array_distinct(F.col(h))) < F.size(F.col(h)), F.sort_array(
        F.transform(F.col(h), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(F.get(F.col(s), j)["x"] == e["x"], F.lit(False))
    d = d.withColumn(p, F.array_sort(F.transform(
        F.filter(F.col(s), lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])))
    covered = F.aggregate(F.transform(F.col(p), lambda x, j: F.least(
        F.lit(WINDOW), F.coalesce(F.get(F.col(p), j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.select(
        *columns,
        F.size(F.col(w)).cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).alias("_lines"),
        (F.length(bare) - F.length(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias(n_up),
        (F.length(bare) - F.length(F.translate(bare, "!?", ""))).alias(n_mark))
    chars, n = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    ratios = {
        "symbol_ratio": F.col("n_symbols") / chars,
        "chars_per_word": F.col("word_chars") / n,
        "upper_ratio": F.col(n_up) / chars,
        "mark_ratio": F.col(n_mark) / chars,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select(*columns, *COUNTS, failed.alias("base_failed"), *[v.alias(k) for k, v in ratios.items()])


def bucket(value: Column) -> Column:
    """Number of the logarithmic bucket; all values up to TINY are bucket 0."""
    return F.when(value <= TINY, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.ceil(F.ln(value / F.lit(TINY)) / F.lit(_ln(GAMMA))))).cast("int")


def _ln(x: float) -> float:
    import math
    return math.log(x)


def value_of(b: Column) -> Column:
    """Middle value of a bucket; 0 for the lowest."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.lit(TINY) * F.pow(F.lit(GAMMA), b) * F.lit(2 / (1 + GAMMA)))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketch of each group; merging is adding n.

    Rows that fail the base rules are left out, so that they do not move the bulk.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(F.col(k)).alias("bucket")) for k in RATIOS])
    return (rows.filter(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("e"))
            .groupBy("lang", "source", "e.ratio", "e.bucket").agg(F.count(F.lit(1)).alias("n")))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, total, lo, mid, hi): deciles 1, 5 and 9 of each merged sketch."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "ratio").orderBy("bucket")
    run = (merged.withColumn("upto", F.sum("n").over(by))
           .withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "ratio"))))
    q = lambda f: F.min(F.when(F.col("upto") >= F.lit(f) * F.col("total"), F.col("bucket")))
    agg = run.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), q(0.1).alias("lo"), q(0.5).alias("mid"), q(0.9).alias("hi"))
    return agg.withColumns({c: value_of(F.col(c)) for c in ("lo", "mid", "hi")})


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, f): for every group, a struct of (low, high) per ratio.

    High fence: median + FENCE * max(median - decile 1, least spread); low fence:
    median - FENCE * max(decile 9 - median, least spread).  Each looks at the other
    side of the median, so junk on its own side, up to half of the rows, cannot move it.
    """
    names = {"lang": "_l", "source": "_s", "ratio": "_r"}
    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("_l"), F.col("ratio").alias("_r"),
                                              F.struct("total", "lo", "mid", "hi").alias("by_lang"))
    every = quantiles(sketch, []).select(F.col("ratio").alias("_a"), F.struct("total", "lo", "mid", "hi").alias("by_all"))
    j = own.join(lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("ratio") == F.col("_r")), "left").drop("_l", "_r")
    j = j.join(every, F.col("ratio") == F.col("_a"), "left").drop("_a")
    def drawn(n: Column, own: Column, to: Column) -> Column:
        return (n * own + F.lit(float(PRIOR_ROWS)) * to) / (n + F.lit(float(PRIOR_ROWS)))

    of_lang = {c: drawn(F.col("by_lang.total"), F.col(f"by_lang.{c}"), F.col(f"by_all.{c}")) for c in ("lo", "mid", "hi")}
    j = j.withColumn("u", F.struct(*[drawn(F.col("total"), F.col(c), v).alias(c) for c, v in of_lang.items()]))
    least = F.element_at(F.create_map(*[x for k, v in RATIOS.items() for x in (F.lit(k), F.lit(v[0]))]), F.col("ratio"))
    high = F.col("u.mid") + FENCE * F.greatest(F.col("u.mid") - F.col("u.lo"), least)
    low = F.col("u.mid") - FENCE * F.greatest(F.col("u.hi") - F.col("u.mid"), least)
    picked = [F.max(F.when(F.col("ratio") == k, F.struct(low.alias("low"), high.alias("high")))).alias(k) for k in RATIOS]
    return j.groupBy("lang", "source").agg(*picked).select(
        F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct(*RATIOS).alias("_fences"))


def quality_rules(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: all) of every row, the counts, base_failed, the ratios and ``kept``.

    Columns of ``docs`` named like one of these results are left out.
    """
    results = {*COUNTS, "base_failed", *RATIOS, "kept"}
    columns = [c for c in (docs.columns if columns is None else columns) if c.lower() not in results]
    judged = _judged(docs.select(F.struct(*columns).alias("_row"), "lang", "source", "text"))
    return judged.select("_row.*", *COUNTS, "base_failed", *RATIOS, "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return _judged(docs.select(F.struct(*docs.columns).alias("_row"), "lang", "source", "text")).filter("kept").select("_row.*")


def _judged(packed: DataFrame) -> DataFrame:
    """(_row, counts, base_failed, ratios, kept) for (_row, lang, source, text)."""
    rows = stored(counted(packed, ["_row", "lang", "source"]), "quality")
    limit = stored(fences(sketches(rows)), "fences")  # small: its size is known when the join is planned
    out = rows.join(limit, rows["lang"].eqNullSafe(F.col("_l")) & rows["source"].eqNullSafe(F.col("_s")), "left")
    bad = F.lit(False)
    for k, (_, above, below) in RATIOS.items():
        f = F.col("_fences")[k]
        if above:
            bad = bad | F.coalesce(F.col(k) > f["high"], F.lit(False))
        if below:
            bad = bad | F.coalesce(F.col(k) < f["low"], F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~bad)
