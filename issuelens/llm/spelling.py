"""Spelling variant grouping by PartEnum signatures of letter multisets.

A word is a binary vector over (letter, occurrence): "seen" has s1, e1, e2, n1.  Words one edit
apart have vectors at Hamming distance one (a letter more) or two (a letter replaced).  The
dimensions are dealt to ``PARTS`` parts by a hash; two differences touch at most two parts, so
two such words agree on the other ``PARTS - 2``.  Each word therefore has one signature per
choice of ``PARTS - 2`` parts (partition, then enumerate), and near words share at least one.
Anagrams share all of them, so a signature also names the half of the word that the edit leaves
alone: one edit lies in the first or in the second half of the shorter word's letters, and the
other half stands unchanged at its end of both words.  Signatures are joined by equality, and
each pair that meets is verified by edit distance.

Where the work runs: occurrences are counted by DataFrame functions, before the shuffle; signatures
are made in Arrow batches of distinct words only, so a frequent word costs what a rare one does.
Pairs are compared inside the join and only near ones leave it.  Roots are found by
pointer doubling over stored tables.  No side of a join is broadcast: all grow with the vocabulary, and Spark sizes them by
the stored words, whose signatures take many times that room.

Defined results: a null text has no words; a null ``doc_id`` is written ``null`` in the crc key;
rows with equal id and text count each; ties between forms go to the word that is least
in code-point order.  A word with no near word has ``n_near`` 0, no form, and itself as root.  An
empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
MISSPELT = 97
MIN_LENGTH, MIN_COUNT = 5, 3
PARTS = 4
RATIO = 2
ROUNDS = 40


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts after the seeded misspelling, with their occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), 0)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")))
    size = F.length("run")
    # Nothing shorter than the least length can become a word, so it is not hashed.
    hashed = runs.filter(size >= min_length).select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % MISSPELT != 0, F.col("run")).otherwise(
        F.concat(F.expr("left(run, cast(h % length(run) as int))"), F.substring("run", at + 2, F.length("run"))))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


def elements(word: str) -> list[str]:
    """The word's letter multiset as (letter, occurrence) strings, in order."""
    out, last, k = [], "", 0
    for c in sorted(word):
        k = k + 1 if c == last else 1
        last = c
        out.append(f"{c}{k}")
    return out


def word_signatures(word: str, parts: int = PARTS) -> tuple[list[int], list[int]]:
    """The signatures of ``word`` as the shorter (or an equally long) word of a pair, and as the longer.

    A signature is a 64-bit hash of the chosen parts' elements, the length of the pair's shorter
    word, and the untouched half.  Equal hashes of unlike words cost a comparison, no more.
    """
    mine: list[list[str]] = [[] for _ in range(parts)]
    for e in elements(word):
        mine[crc32(e.encode()) % parts].append(e)
    chosen = ["|".join(f"{p}:{''.join(mine[p])}" for p in kept) for kept in combinations(range(parts), parts - 2)]
    out = []
    for shorter in (len(word), len(word) - 1):
        # Of the shorter word's letters but one (the one replaced), a half stands at the front of
        # both words, or the other half at their end.
        front = (shorter - 1) // 2
        tail = shorter - 1 - front
        halves = (f"{shorter}<{word[:front]}", f"{shorter}>{word[len(word) - tail:]}")
        out.append([xxhash.xxh64_intdigest(f"{half}|{c}".encode()) - (1 << 63) for half in halves for c in chosen])
    return out[0], out[1]


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(sig, longer, word, n): every signature of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [word_signatures(w, parts) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array([s[i] for s in both], pa.list_(pa.int64())) for i in (0, 1)]],
                names=["word", "n", "same", "longer"])

    made = words.select("word", "n").mapInArrow(run, "word string, n bigint, same array<bigint>, longer array<bigint>")
    rows = made.select("word", "n", F.size("same").alias("_k"), F.posexplode(F.concat("same", "longer")).alias("_i", "sig"))
    return rows.select("sig", (F.col("_i") >= F.col("_k")).alias("longer"), "word", "n")


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, na, b, nb): every pair of words exactly one edit apart, once; b is longer, or as long and greater."""
    sig = signatures(words, parts)
    a = sig.filter(~F.col("longer")).select(F.col("sig").alias("s"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = sig.select("sig", "longer", F.col("word").alias("b"), F.col("n").alias("nb"))
    near = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b.hint("merge"), (F.col("s") == F.col("sig")) & near).select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form: forms followed to the last, by pointer doubling.

    Counts at least double along a chain, so its length is at most the binary logarithm of the largest count.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        step = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = at.join(step.hint("merge"), F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved"))
        moved = stored(moved, "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")
    raise RuntimeError("chains of forms did not end")


def variant_groups(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; distinct words)."""
    words = stored(words, "words")
    pairs = near_pairs(words, parts)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("p")).select("p.*")
    # The near word of largest count, least in code-point order among equals.
    best = F.min(F.struct((-F.col("m")).alias("m"), "near"))
    of = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).withColumnRenamed("word", "_w")
    takes = -F.col("best.m") >= RATIO * F.col("n")
    judged = words.join(of.hint("merge"), F.col("word") == F.col("_w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"))
    judged = stored(judged, "forms")
    ends = roots(judged.filter("form is not null")).select(F.col("word").alias("_w"), F.col("root").alias("_root"))
    return judged.join(ends.hint("merge"), F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every frequent word of ``docs``."""
    return variant_groups(word_counts(docs))
