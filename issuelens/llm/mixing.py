"""Mix sources to target weights by Efraimidis-Spirakis weighted sampling.

Sources in code-point order (null last) get the weights 3, 1, 2, repeating, and
share ``total_share`` times all words; a source's target stops at ``cap`` times its
size and the excess goes to the others by weight.  A target holds as many complete
epochs of its source as fit; the rest is a weighted sample without replacement:
each document gets the exponential key ``-ln(u) / quality``, documents are sorted
by key within their source and taken while the running sum of sizes stays within
the budget (the document on the edge is taken if that brings the sum nearer).

The sort is distributed even if one source holds most rows: narrow rows without
texts are range-partitioned by (source, key), running sums are taken inside each
part and the totals of the parts before it are added.  What leaves the sort is one
edge per source, the greatest key that is taken.

Defined results: a null or blank text has size 0 and is never picked by the sample;
a null source is a source of its own; rows with equal id and text get equal keys
and are taken together or not at all; an empty table gives an empty result; extra columns
pass through ``mix_documents`` unchanged.  Reruns agree: ``u`` is a digest of the id,
the text and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, free_name, stored, words_of

WEIGHT_CYCLE = (3.0, 1.0, 2.0)
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column, n_words: Column) -> Column:
    """Quality in [0.05, 1]: few markup symbols, and at least 50 words for full weight."""
    bare = F.translate(text, SPACES, "")
    chars = F.length(bare)
    symbols = chars - F.length(F.translate(bare, SYMBOLS, ""))
    clean = F.lit(1.0) - F.lit(2.0) * symbols / F.greatest(chars, F.lit(1))
    length = F.least(F.lit(1.0), n_words / F.lit(50.0))
    return F.greatest(F.lit(0.05), clean * length)


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 digest."""
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")),
                        F.md5(F.coalesce(text, F.lit(""))))
    first = F.conv(F.substring(F.md5(ident), 1, 13), 16, 10).cast("long")
    return (first.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, total_share: float = 1.5, cap: float = 2.0,
                   cycle=WEIGHT_CYCLE) -> DataFrame:
    """(source, source_size, n_docs, target): one row per source; null sources included.

    Water filling in closed form: sources are sorted by cap / weight; those whose
    cap lies below the common level are full, the others share what is left by weight.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(rank - 1, F.lit(len(cycle))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.lit(total_share) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(upto), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    per = per.withColumn("level", left / share)
    # The level at the first source whose cap is not reached holds for all that follow.
    open_ = F.col("full") / F.col("weight") > F.col("level")
    per = per.withColumn("level", F.min(F.when(open_, F.struct(F.col("full") / F.col("weight"), F.col("level")))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least("full", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def edges(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, last): ``last`` is the greatest (key, digest) that
    the sample takes, null if it takes none.  One row per source.

    ``rows`` has (source, size, key, digest).  They are range-partitioned by (source, key,
    digest) and stored with their partition as ``slice``, so that a source of any size is
    sorted by many tasks; a running sum inside each slice starts at the total of the slices
    before it.  Rows with equal key and digest are taken together or not at all.
    """
    cut = rows.repartitionByRange("source", "key", "digest").withColumn("slice", F.spark_partition_id())
    cut = stored(cut.select("source", "slice", "size", "key", "digest"), "mix-slices")
    per = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long")))
    totals = cut.groupBy("source", "slice").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("earlier", F.coalesce(F.sum("total").over(before), F.lit(0)))
    totals = totals.join(per.select(F.col("source").alias("_t"), "epochs", "source_size", "target"),
                         F.col("source").eqNullSafe(F.col("_t"))).select(
        F.col("source").alias("_s"), F.col("slice").alias("_k"), "earlier",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "digest")
    run = cut.withColumn("upto", F.sum("size").over(inside))  # a range frame: ties are summed together
    run = run.join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_k")))
    middle = F.col("upto") + F.col("earlier") - F.col("size") / 2
    taken = run.filter((F.col("size") > 0) & (middle <= F.col("budget")))
    last = taken.groupBy(F.col("source").alias("_s")).agg(F.max(F.struct("key", "digest")).alias("last"))
    return per.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "source_size", "target", "epochs", "last")


def copies_of(size: Column, key: Column, digest: Column) -> Column:
    """How often a document is taken, given its source's row of ``edges``."""
    sampled = F.coalesce((size > 0) & (F.struct(key.alias("key"), digest.alias("digest")) <= F.col("last")), F.lit(False))
    return F.coalesce(F.col("epochs"), F.lit(0)) + sampled.cast("long")


def with_keys(docs: DataFrame, names: dict[str, str], seed: int) -> DataFrame:
    """``docs`` plus its size, key and digest under the given names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn(names["size"], F.size(words_of(F.col("text"))).cast("long"))
    d = d.withColumn(names["digest"], uniform(F.col("doc_id"), F.col("text"), seed))
    return d.withColumn(names["key"], -F.ln(F.col(names["digest"])) / quality_weight(text, F.col(names["size"])))


def decisions(docs: DataFrame, seed: int, total_share: float, cap: float, cycle) -> tuple[DataFrame, DataFrame]:
    """(narrow stored rows, one row of ``edges`` per source)."""
    names = {n: n for n in ("size", "digest", "key")}
    rows = stored(with_keys(docs.select("doc_id", "source", "text"), names, seed).drop("text"), "mix-rows")
    return rows, stored(edges(rows, source_targets(rows, total_share, cap, cycle)), "mix-edges")


def mix_sizes(docs: DataFrame, seed: int = 7, total_share: float = 1.5, cap: float = 2.0,
              cycle=WEIGHT_CYCLE) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, key, digest) for every row."""
    rows, per = decisions(docs, seed, total_share, cap, cycle)
    out = rows.join(per.withColumnRenamed("source", "_s"), rows["source"].eqNullSafe(F.col("_s")), "left")
    out = out.withColumn("copies", copies_of(F.col("size"), F.col("key"), F.col("digest")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"), "key", "digest")


def mix_documents(docs: DataFrame, seed: int = 7, total_share: float = 1.5, cap: float = 2.0,
                  cycle=WEIGHT_CYCLE) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns.

    A row's key is compared with its source's edge, so no text is shuffled unless the
    table of sources is too large to broadcast.
    """
    _, per = decisions(docs, seed, total_share, cap, cycle)
    names = {n: free_name(docs, f"_{n}") for n in ("size", "digest", "key")}
    out = with_keys(docs, names, seed)
    s = free_name(out, "_source")
    per = per.select(F.col("source").alias(s), F.struct("epochs", "last").alias(free_name(out, "_edge")))
    edge = per.columns[1]
    out = out.join(per, out["source"].eqNullSafe(F.col(s)), "left")
    size, key, digest = (F.col(names[n]) for n in ("size", "key", "digest"))
    sampled = (size > 0) & (F.struct(key.alias("key"), digest.alias("digest")) <= F.col(f"{edge}.last"))
    copies = F.coalesce(F.col(f"{edge}.epochs"), F.lit(0)) + F.coalesce(sampled, F.lit(False)).cast("int")
    n = free_name(out, "_n")
    out = out.withColumn(n, copies.cast("int")).filter(F.col(n) > 0)
    return out.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*docs.columns)
