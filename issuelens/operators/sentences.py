"""Sentence splitting that learns abbreviations from the texts.

A period after an abbreviation ends no sentence.  Which words are abbreviations is learnt without labels,
after Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006): a log-likelihood
ratio tells whether a word comes with a period nearly always rather than as often as any word;
it is scaled down for long words and for every time that the word stands without a period, and up for
periods inside.  Of the paper only this first, type-based step is used: initials, ordinals and
abbreviations at the end of a sentence are not told apart.

Counts are one grouped aggregate.  A text's candidate boundaries are joined with the abbreviations as narrow
(id, place, word) rows, and come back as one array of places per text.

Null texts have no sentences (an empty array); ``id_col`` names a row, so it must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\p{L}[\p{L}.]*"            # with the periods in and after it
BOUNDARY = r"([.!?]+[ \n]+)"
LAST_WORD = r"(\p{L}[\p{L}.]*)\.[ \n]+$"
CUT = "\x01"                       # put behind a boundary; taken out of texts first
ALWAYS = 0.99                      # share of an abbreviation's places that have a period
LEAST_SCORE = 0.3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(df: DataFrame, text: Column) -> DataFrame:
    """``(word, n, k)``: how often each word stands, and how often with just one period behind it."""
    tokens = df.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), 0)).alias("t"))
    word = F.translate(F.regexp_replace("t", r"\.+$", ""), UPPER, LOWER)
    single = F.col("t").endswith(".") & ~F.col("t").endswith("..")
    return tokens.select(word.alias("word"), single.cast("long").alias("p")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("k"))


def abbreviations(df: DataFrame, text: Column) -> DataFrame:
    """``(word, n, k, score)`` of the words that are abbreviations in ``df``'s texts."""
    counts = word_counts(df, text).withColumn("one", F.lit(1))
    share = counts.groupBy("one").agg((F.sum("k") / F.sum("n")).alias("p0"))     # one row
    k, n, p0 = F.col("k"), F.col("n"), F.col("p0")
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    gain = k * (F.log(F.lit(ALWAYS)) - F.log(p0)) + (n - k) * (F.log(F.lit(1 - ALWAYS)) - F.log(1 - p0))
    inner = F.length("word") - letters
    score = 2 * gain * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), (k - n).cast("double"))
    scored = counts.filter("k > 0").join(share, "one").select("word", "n", "k", score.alias("score"))
    return scored.filter(F.col("score") >= LEAST_SCORE)


def pieces(text: Column) -> Column:
    """The text cut behind every run of . ! ? that blanks follow; nothing is left out."""
    marked = F.regexp_replace(F.translate(text, CUT, " "), BOUNDARY, "$1" + CUT)
    return F.filter(F.split(marked, CUT), lambda p: F.length(p) > 0)


def sentences(df: DataFrame, text: Column, abbreviations: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, sentences)``: pieces that end in an abbreviation are joined with the next; blanks at the ends go."""
    cut = df.select(F.col(id_col), pieces(text).alias("_all"))
    last = F.translate(F.regexp_extract("_piece", LAST_WORD, 1), UPPER, LOWER)
    ends = cut.select(id_col, F.posexplode("_all").alias("_at", "_piece")).select(id_col, "_at", last.alias("word")).filter("word <> ''")
    open_ = ends.join(abbreviations.select("word"), "word", "left_semi").groupBy(id_col).agg(F.collect_list("_at").alias("_open"))
    # The boundaries that stay get the mark back, and the joined text is split there.
    text_of = F.array_join(F.transform("_all", lambda p, i: F.when(F.array_contains("_open", i), p).otherwise(F.concat(p, F.lit(CUT)))), "")
    out = cut.join(open_, id_col, "left").withColumn("_open", F.coalesce("_open", F.array().cast("array<int>")))
    found = F.transform(F.split(text_of, CUT), lambda s: F.regexp_replace(s, r"^[ \n]+|[ \n]+$", ""))
    return out.select(id_col, F.coalesce(F.filter(found, lambda s: F.length(s) > 0), F.array().cast("array<string>")).alias("sentences"))
