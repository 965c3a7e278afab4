"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the vectors recursively: a node projects them on a random direction and
cuts near the median; vectors close to the cut go to both sides (spill overlap).  All
pairs inside a leaf are compared exactly (cosine in double precision), and links join
components by union.  Trees are as many as make a pair at the threshold share a leaf
somewhere with probability 0.999; how often it does in one tree is measured on the sample.

The top of the forest is fitted on at most about ``SAMPLE`` vectors on the driver (a documented
bound) and applied to every vector; a leaf that is still too large is split again by
directions seeded with its key and quantiles of all its vectors.  A leaf that no
split shrinks (a dense ball of near copies) is compared in blocks, each pair of
blocks in a task of its own.  A pair is counted only in the first leaf, in key order,
that both vectors share, and a leaf emits one count per vector and one edge per vector
to its group, never the pairs themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of different lengths do
not link; equal vectors are one class, compared once, and count each other as
links; null ids count as vectors but never name a component that has another id; an
empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

THRESHOLD = 0.9
LEAF = 1024            # aimed at vectors per leaf
BLOCK = 2048           # most vectors compared by one task at once
SAMPLE = 20_000
SPILL = 0.05           # share of a node's vectors on either side of the cut that go to both,
WIDTH = 0.126          # and all this near to the cut (a random projection of unit vectors spreads by 1)
LEAST_KEEP = 0.001     # below this measured share a forest would need over 6,900 trees; then it raises
SHRINK = 0.7           # a split is made only if no side keeps more than this share
KEEP = 0.91            # chance per split that a pair at cosine 0.9 stays together for vectors spread evenly round the origin; no more is assumed of others


def usable(embedding: Column) -> Column:
    return (embedding.isNotNull() & (F.size(embedding) > 0)
            & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(embedding, lambda x: x != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that no square over- or underflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def direction(dim: int, *key: int) -> np.ndarray:
    return np.random.default_rng([abs(k) for k in key]).standard_normal(dim)


class Forest:
    """Directions and cuts of the top ``depth`` levels of every tree."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        self.trees, self.depth, dim = trees, depth, sample.shape[1]
        self.way, self.cut = {}, {}
        for t in range(trees):
            held = {1: np.arange(len(sample))}
            for node in range(1, 1 << depth):
                rows = held.pop(node, None)
                if rows is None or not len(rows):
                    continue
                way = direction(dim, seed, t, node)
                p = sample[rows] @ way
                low, mid, high = np.quantile(p, [0.5 - SPILL, 0.5, 0.5 + SPILL])
                low, high = min(low, mid - WIDTH), max(high, mid + WIDTH)
                left, right = rows[p <= high], rows[p >= low]
                if max(len(left), len(right)) <= SHRINK * len(rows):
                    self.way[t, node], self.cut[t, node] = way, (low, high)
                    held[2 * node], held[2 * node + 1] = left, right

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf key) of every leaf that each row falls into."""
        row, key = [], []
        for t in range(self.trees):
            held = {1: np.arange(len(x))}
            for node in range(1, 1 << self.depth):
                if (t, node) in self.way:
                    rows = held.pop(node)
                    p = x[rows] @ self.way[t, node]
                    low, high = self.cut[t, node]
                    held[2 * node], held[2 * node + 1] = rows[p <= high], rows[p >= low]
            for node, rows in held.items():
                row.append(rows)
                key.append(np.full(len(rows), (t << 32) + node, np.int64))
        return np.concatenate(row), np.concatenate(key)


def tree_chance(sample: np.ndarray, n: int, threshold: float, depth: int, most: int, seed: int, trials: int = 24) -> float:
    """Chance that one tree over ``n`` vectors keeps a pair at the threshold together.

    Pairs differ in it, so it is taken from the share of pairs that half of the trials all miss,
    and three standard errors.

    Trial trees split the sample as the forest and ``_refine`` split all vectors, down to leaves
    that stand for ``most`` vectors; a made partner at the threshold goes along with each
    vector.  Where too little of the sample is left, further splits count as the ones before.
    """
    rng = np.random.default_rng(seed)
    dim, scale = sample.shape[1], n / len(sample)
    x = sample[rng.permutation(len(sample))[:2000]]
    off = rng.standard_normal(x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.maximum(np.sqrt((off * off).sum(axis=1, keepdims=True)), 1e-12)
    y = threshold * x + max(0.0, 1 - threshold * threshold) ** 0.5 * off
    hits = np.zeros(len(x), np.int64)
    for _ in range(trials):
        chance = np.zeros(len(x))
        met = kept = 0
        shares, early = [], []
        held = [(np.arange(len(sample)), np.arange(len(x)), 0)]
        while held:
            rows, pairs, level = held.pop()
            if level >= depth and len(rows) * scale <= most or not len(pairs):
                chance[pairs] = 1
                continue
            if len(rows) < 32:
                early.append((pairs, len(rows) * scale / most))
                continue
            way = rng.standard_normal(dim)
            p = sample[rows] @ way
            low, mid, high = np.quantile(p, [0.5 - SPILL, 0.5, 0.5 + SPILL])
            low, high = min(low, mid - WIDTH), max(high, mid + WIDTH)
            left, right = rows[p <= high], rows[p >= low]
            if max(len(left), len(right)) > SHRINK * len(rows):
                chance[pairs] = 1
                continue
            a, b = x[pairs] @ way, y[pairs] @ way
            on_left, on_right = np.maximum(a, b) <= high, np.minimum(a, b) >= low
            met, kept = met + len(pairs), kept + int((on_left | on_right).sum())
            shares.append(max(len(left), len(right)) / len(rows))
            held += [(left, pairs[on_left], level + 1), (right, pairs[on_right], level + 1)]
        for pairs, over in early:
            levels = ceil(log(max(over, 1.0)) / -log(np.mean(shares))) if shares else 0
            chance[pairs] = np.maximum(chance[pairs], (kept / max(met, 1)) ** levels)
        hits += rng.random(len(x)) < chance
    half = trials // 2
    missed = np.array([comb(trials - k, half) / comb(trials, half) for k in hits.tolist()])
    share = missed.mean() + 3 * missed.std() / len(x) ** 0.5
    keep = 1 - float(share) ** (1 / half) if share else 1.0
    if keep < LEAST_KEEP:
        raise ValueError(f"a tree keeps only {keep:.5f} of the pairs at the threshold together: a wider SPILL or larger leaves are needed")
    return keep


def _assign(vectors: DataFrame, dim: int, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, key = forest.leaves(matrix(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(key)], names=["cid", "leaf"])
    return vectors.select("cid", "embedding").mapInArrow(run, "cid bigint, leaf bigint")


def _refine(leaves: DataFrame, vectors: DataFrame, dim: int, leaf_rows: int, seed: int) -> DataFrame:
    """Split leaves of more than ``leaf_rows`` rows until no split shrinks them."""
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, key = matrix(b.column(2), dim), b.column(1).to_numpy()
                p = np.empty(len(x))
                for k in np.unique(key):
                    p[key == k] = x[key == k] @ direction(dim, seed, int(k))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p)], names=["cid", "leaf", "p"])

    leaves = leaves.withColumn("whole", F.lit(False))
    while True:
        sizes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("w"))
        big = sizes.filter((F.col("n") > leaf_rows) & ~F.col("w")).select("leaf", "n")
        if big.isEmpty():
            return leaves.select("cid", "leaf")
        big = stored(big, "large-leaves")
        rest = leaves.join(big, "leaf", "left_anti")
        at = leaves.join(big.select("leaf"), "leaf").join(vectors.select("cid", "embedding"), "cid")
        p = stored(at.select("cid", "leaf", "embedding").mapInArrow(project, "cid bigint, leaf bigint, p double"), "projections")
        cut = p.groupBy("leaf").agg(F.percentile_approx("p", [0.5 - SPILL, 0.5, 0.5 + SPILL], 1000).alias("q"))
        cut = cut.select("leaf", F.least(F.col("q")[0], F.col("q")[1] - WIDTH).alias("low"),
                         F.greatest(F.col("q")[2], F.col("q")[1] + WIDTH).alias("high")).join(big, "leaf")
        sides = F.array(F.when(F.col("p") <= F.col("high"), F.xxhash64("leaf", F.lit(0))),
                        F.when(F.col("p") >= F.col("low"), F.xxhash64("leaf", F.lit(1))))
        split = p.join(cut, "leaf").select("cid", F.col("leaf").alias("from"), "n", F.explode(F.array_compact(sides)).alias("leaf"))
        split = stored(split, "split")
        child = split.groupBy("from", "leaf").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
        stuck = child.groupBy("from").agg(F.max(F.col("m") > SHRINK * F.col("n")).alias("whole"))
        done = split.join(stuck, "from").select("cid", F.when(F.col("whole"), F.col("from")).otherwise(F.col("leaf")).alias("leaf"), "whole")
        leaves = stored(rest.select("cid", "leaf", "whole").unionByName(done.distinct()), "leaves")


def _compare(rows: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(cid, links, other): links counted in a leaf, and an edge to the least vector of its group."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cid, n = t["cid"].to_numpy(), t["n"].to_numpy()
        leaf, low, high = (t[c][0].as_py() for c in ("leaf", "low", "high"))
        x = matrix(t["embedding"].combine_chunks(), dim)
        hit = (x @ x.T) >= threshold
        np.fill_diagonal(hit, False)
        if low != high:
            block = t["block"].to_numpy()
            hit &= block[:, None] != block[None, :]
        held = np.flatnonzero(hit.any(axis=1))
        hit = hit[np.ix_(held, held)]
        # Leaves that come before this one and hold two of the rows: their links are counted there.
        lists = t["leaves"].combine_chunks().take(pa.array(held))
        owner = np.repeat(np.arange(len(held)), np.diff(lists.offsets.to_numpy()))
        keys = lists.flatten().to_numpy()
        early = keys < leaf
        if early.any():
            _, column = np.unique(keys[early], return_inverse=True)
            inside = np.zeros((len(held), int(column.max()) + 1), np.float32)
            inside[owner[early], column] = 1
            hit &= (inside @ inside.T) == 0
        links = hit @ n[held]
        group = np.arange(len(held))
        while len(held):
            least = np.where(hit, group[None, :], len(held)).min(axis=1)
            new = np.minimum(group, least)
            new = new[new]
            if (new == group).all():
                break
            group = new
        out = links > 0
        return pa.table({"cid": cid[held][out], "links": links[out].astype(np.int64), "other": cid[held][group[out]]})

    keys = ["leaf", "low", "high"]
    return rows.groupBy(*keys).applyInArrow(run, "cid bigint, links bigint, other bigint")


def linked_classes(vectors: DataFrame, dim: int, n: int, threshold: float = THRESHOLD, seed: int = 5,
                   leaf_rows: int = LEAF, block_rows: int = BLOCK, sample_rows: int = SAMPLE) -> DataFrame:
    """(cid, links, other) summed over leaves later; ``vectors`` is stored (cid, embedding, n)."""
    want = max(0, ceil(log(max(n, 1) / leaf_rows, 2)))
    depth = min(want, max(0, int(log(max(min(n, sample_rows), 1) / 32, 2))))
    part = vectors.filter(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_rows / max(n, 1))))
    sample = part.select("embedding").toArrow()["embedding"].combine_chunks() if depth else pa.array([], pa.list_(pa.float32()))
    sample = matrix(sample, dim) if len(sample) else np.zeros((0, dim))
    share = 0.999
    chance = KEEP ** want
    if depth and len(sample):
        chance = min(chance, tree_chance(sample, n, threshold, depth, block_rows, seed))
    trees = 1 if want == 0 else ceil(log(1 - share) / log(1 - chance))
    forest = Forest(sample, trees, depth, seed)
    leaves = stored(_assign(vectors, dim, forest), "leaves")
    leaves = _refine(leaves, vectors, dim, block_rows, seed)
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    lists = leaves.groupBy("cid").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    rows = leaves.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("cid", "leaf"), F.col("blocks")).cast("int"))
    # Each row meets every block: (least, greatest) of its own block and the other's.
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cid", "leaf", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    rows = rows.join(vectors.join(lists, "cid"), "cid")
    return _compare(rows.select("cid", "leaf", "low", "high", "block", "n", "embedding", "leaves"), dim, threshold)


def link_vectors(table: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    e = F.col("embedding")
    good = table.select("vec_id", "embedding").filter(usable(e))
    classes = stored(good.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
                     .withColumn("cid", F.monotonically_increasing_id()), "vectors")
    found = None
    for r in classes.groupBy(F.size("embedding").alias("dim")).count().collect():
        part = linked_classes(classes.filter(F.size("embedding") == r["dim"]), r["dim"], r["count"], threshold, **options)
        found = part if found is None else found.union(part)
    if found is None:
        return table.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    found = stored(found, "leaf-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    named = (classes.drop("embedding").join(links, "cid", "left")
             .join(groups, F.col("cid") == F.col("node"), "left")
             .withColumn("group", F.coalesce("component", "cid")))
    least = named.groupBy("group").agg(F.min("first").alias("least"))
    named = stored(named.join(least, "group").select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least"), "named")
    named = classes.select("cid", "embedding").join(named, "cid").drop("cid").withColumnRenamed("embedding", "_e")
    rows = table.select("vec_id", "embedding").withColumn("_ok", usable(e))
    out = rows.join(named, F.col("_ok") & (F.col("embedding") == F.col("_e")), "left")
    component = F.when(F.col("_e").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
