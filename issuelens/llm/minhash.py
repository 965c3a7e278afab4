"""Near-duplicate documents by BagMinHash signatures over word shingles.

A document is a bag of five-word shingles (a shorter text is one shingle).  The
signature is unbiased for the weighted Jaccard similarity: each shingle's weight (its
count) is covered by dyadic intervals [0,1), [1,2), [2,4), ...; every interval has its
own Poisson process, seeded by shingle and interval, with the interval's length as
rate.  A point has a time, a component of the signature and, in the last interval, a
place that must lie below the weight; a component keeps its earliest point.  Only
points before a horizon are made, which is doubled if a component stays empty.

Signatures are banded; equal bands make candidates, and a pair is linked if the exact
weighted Jaccard similarity of the two bags is ``THRESHOLD`` or more.  Equal texts
share one key and are never compared.  A bucket does not emit all its pairs: members are
first compared with two pivots; after that only pairs of different components count, and
of these only pairs whose odd sketches (each shingle flips one of ``SKETCH_BITS`` bits)
differ in no more bits than a similar pair does, five standard deviations included.  First
each member's best such partner is verified, which joins most of what can be joined,
then every one that is left.

Defined results: null, empty and blank texts have no shingles and link with nothing;
equal rows are in one class; an empty table gives an empty result; extra columns
pass through ``drop_near_copies`` unchanged.  Texts are keyed by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import grown, mixed_buckets, pivot_pairs, shared_buckets
from .common import free_name, stored
from .components import components

WORDS = 5
THRESHOLD = 0.8
SKETCH_BITS = 4096
BLOCK = 4096            # most members at home in one block of a bucket
BANDS, ROWS = 40, 8     # finds a pair at similarity 0.8 with probability 0.9994

_G1, _G2, _G3, _G4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S11 = (np.uint64(x) for x in (30, 27, 31, 11))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shingles(text: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of each different shingle; bytes.split() cuts at the six ASCII blanks."""
    w = text.split()
    if not w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = mix(s * _G1 + h[i:i + n])
    return np.unique(s, return_counts=True)


def signature(d: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash signature of a bag with hashes ``d`` and whole weights ``w`` > 0."""
    horizon = size * (log(size) + 4) / float(w.sum())
    top = int(w.max())
    while True:
        ids, times, level = [], [], 0
        while True:
            low = 0 if level == 0 else 1 << (level - 1)
            if low >= top:
                break
            rate = max(1, low)
            held = w > low if low else slice(None)
            e, limit = mix(d[held] + np.uint64((level + 1) * int(_G2) % (1 << 64))), w[held]
            t, first, step = np.zeros(len(e)), 0, int(rate * horizon) + 1
            while len(e):
                x = mix(e[:, None] + np.arange(first + 1, first + step + 1, dtype=np.uint64) * _G3)
                u = ((x >> _S11).astype(np.float64) + 0.5) * (1.0 / (1 << 53))
                at = t[:, None] + np.cumsum(-np.log(u), axis=1) / rate
                hit = at < horizon
                if low:
                    hit &= (low + (mix(x ^ _G4) % np.uint64(rate)).astype(np.int64)) < limit[:, None]
                ids.append(x[hit])
                times.append(at[hit])
                alive = at[:, -1] < horizon
                e, limit, t, first = e[alive], limit[alive], at[alive, -1], first + step
                step = max(1, step // 4)
            level += 1
        x, at = np.concatenate(ids), np.concatenate(times)
        slot = (mix(x ^ _G1) % np.uint64(size)).astype(np.int64)
        order = np.argsort(-at, kind="stable")
        best = np.full(size, -1, np.int64)
        best[slot[order]] = order          # the last one written is the earliest point
        if (best >= 0).all():
            return x[best]
        horizon *= 2


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _G2
    for i in range(rows):
        key = mix(key * _G1 + parts[:, i])
    return key.view(np.int64)


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two bags (hashes sorted)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both) if both else 0.0


def odd_sketch(d: np.ndarray, w: np.ndarray) -> bytes:
    """Parity, in ``SKETCH_BITS`` slots, of all shingle occurrences of a bag."""
    nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    x = mix(np.repeat(d, w) + nth.astype(np.uint64) * _G4) & np.uint64(SKETCH_BITS - 1)
    return np.packbits(np.bincount(x.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def most_bits(weights: np.ndarray, threshold: float) -> np.ndarray:
    """Most bits in which the sketches of two bags of this total weight differ if they are similar.

    Bags at the threshold differ in d = weight (1 - t) / (1 + t) occurrences, which leave
    about m (1 - exp(-2d/m)) / 2 of m bits odd.
    """
    m, d = SKETCH_BITS, weights * ((1 - threshold) / (1 + threshold))
    stay = np.exp(-4 * d / m)
    spread = np.sqrt(np.maximum(1.0, m / 4 * (1 - stay) - d * stay))
    return m / 2 * (1 - np.exp(-2 * d / m)) + 5 * spread + 1


def with_bands(docs: DataFrame, id_col: str, text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
               words: int = WORDS) -> DataFrame:
    """(id, key, bands, sketch, weight) per row; all but id and weight are null for a text without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sketches, weights = [], [], []
            for t in b.column(2).cast(pa.binary()):
                d, w = shingles(t.as_py() or b"", words)
                sig = signature(d, w, bands * rows) if len(d) else None
                keys.append(None if sig is None else band_keys(sig, bands, rows))
                sketches.append(None if sig is None else odd_sketch(d, w))
                weights.append(int(w.sum()))
            found = pa.array([x is not None for x in keys], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.compute.if_else(found, b.column(1), pa.scalar(None, pa.int64())),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(weights, pa.int64())],
                names=["id", "key", "bands", "sketch", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows_ = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows_.mapInArrow(run, f"id {kind}, key bigint, bands array<bigint>, sketch binary, weight bigint")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; ``texts`` has (key, text), one row a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            keep = []
            for i in range(len(a)):
                if a[i] != last:
                    last, bag = a[i], shingles(ta[i].as_py(), words)
                keep.append(similarity(bag, shingles(tb[i].as_py(), words)) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of_b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _partners(group: pa.Table, threshold: float, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different parts, one row at home and one visiting, whose sketches may belong to similar bags."""
    key, part, home, weight = (group[c].to_numpy() for c in ("key", "part", "home", "weight"))
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
    inner = np.flatnonzero(home)
    found_a, found_b = [], []
    for i in np.flatnonzero(~home):
        ok = inner[part[inner] != part[i]]
        both = weight[ok] + weight[i]
        differ = np.bitwise_count(sketch[ok] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(differ <= most_bits(both, threshold))
        if best and len(hit):
            hit = hit[(differ[hit] / both[hit]).argmin()][None]
        found_a.append(np.full(len(hit), key[i]))
        found_b.append(key[ok[hit]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    return np.minimum(a, b), np.maximum(a, b)


def meetings(tagged: DataFrame) -> DataFrame:
    """(band, block, visit, key, part, home) of ``tagged`` (band, key, part): who meets whom.

    A bucket's members are dealt to blocks, and those outside its largest part, which visit the
    blocks, are dealt to blocks of visitors.  Every block meets every block of visitors in a group of
    its own, so no group has more than two blocks' rows, however many parts a bucket has.
    """
    per = tagged.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("band").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("total"))
    per = per.select("band", "main.part", "main.n", "total").withColumnsRenamed({"part": "main", "n": "n_main"})
    t = tagged.join(per, "band")
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    visits = F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("n_main")) / BLOCK).cast("int"))
    at_home = t.select("band", "key", "part", F.pmod(F.xxhash64("key", "band"), blocks).cast("int").alias("block"),
                       F.explode(F.sequence(F.lit(0), visits - 1)).alias("visit"), F.lit(True).alias("home"))
    visiting = t.filter(F.col("part") != F.col("main")).select(
        "band", "key", "part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
        F.pmod(F.xxhash64("band", "key"), visits).cast("int").alias("visit"), F.lit(False).alias("home"))
    return at_home.union(visiting)


def likely_pairs(tagged: DataFrame, sketches: DataFrame, threshold: float, best: bool) -> DataFrame:
    """Distinct (a, b) of different parts that share a bucket and look similar; ``tagged`` has (band, key, part)."""
    t = meetings(tagged).join(sketches, "key").select("band", "block", "visit", "key", "part", "home", "sketch", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            of = [t[c].to_numpy() for c in ("band", "block", "visit")]
            ends = np.flatnonzero(np.any([x[1:] != x[:-1] for x in of], axis=0)) + 1
            for i, j in zip([0, *ends], ends, strict=False):
                yield _pairs_batch(t.slice(i, j - i))
            rest = t.slice(ends[-1]) if len(ends) else t
        if rest is not None and len(rest):
            yield _pairs_batch(rest)

    def _pairs_batch(group: pa.Table) -> pa.RecordBatch:
        a, b = _partners(group.combine_chunks(), threshold, best)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    t = t.repartition("band", "block", "visit").sortWithinPartitions("band", "block", "visit")
    return t.mapInArrow(run, "a bigint, b bigint").distinct()


def linked_keys(rows: DataFrame, docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
                words: int = WORDS) -> DataFrame:
    """(node, component) over text keys, for keys that link with another.

    ``rows`` is stored (id, key, bands, sketch, weight); ``docs`` is read again for the texts of candidates.
    """
    rows = rows.filter("key is not null")
    shared = shared_buckets(rows.select("key", "bands").dropDuplicates(["key"]).select("key", F.explode("bands").alias("band")))
    members = stored(shared.select("key").distinct(), "candidates")
    texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).join(members, "key", "left_semi")
    texts = stored(texts.groupBy("key").agg(F.first("text").alias("text")), "candidate-texts")
    sketches = rows.join(members, "key", "left_semi").select("key", "sketch", "weight").dropDuplicates(["key"])
    sketches = stored(sketches, "sketches")

    tested = pivot_pairs(shared)
    groups = stored(components(stored(verified(tested, texts, threshold, words), "pivot-links")), "components")
    for best in (True, False):
        pairs = likely_pairs(mixed_buckets(shared, groups), sketches, threshold, best)
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "likely-pairs")
        links = stored(verified(pairs, texts, threshold, words), "links")
        groups = stored(grown(groups, links), "components")
        tested = tested.union(pairs)
    return groups


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 words: int = WORDS) -> DataFrame:
    """(id, class_key) per row; class_key is null for a text without words."""
    rows = stored(with_bands(docs, id_col, text_col, words=words), "signatures")
    linked = linked_keys(rows, docs, text_col, threshold, words)
    out = rows.select("id", "key").join(linked, F.col("key") == F.col("node"), "left")
    return out.select("id", F.coalesce("component", "key").alias("class_key"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(doc_id, class_id, class_size, kept) per row: the class is named by its least doc_id."""
    rows = stored(near_classes(docs, "doc_id", "text", threshold, words), "classes")
    named = rows.filter("class_key is not null").groupBy("class_key").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("class_key", "c")
    out = rows.join(named, F.col("class_key") == F.col("c"), "left")
    class_id = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias("doc_id"), class_id.alias("class_id"),
                      F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
                      F.col("id").eqNullSafe(class_id).alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row of each class, the one with the least doc_id; all rows without words."""
    row = free_name(docs, "_row")
    tagged = stored(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    rows = stored(near_classes(tagged, row, "text", threshold, words), "classes")
    rows = rows.filter("class_key is not null")
    many = rows.groupBy("class_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("class_key").alias("c"))
    rows = rows.join(many, F.col("class_key") == F.col("c")).select("id", "class_key")
    rows = stored(rows.join(tagged.select(F.col(row).alias("id"), "doc_id"), "id"), "copies")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "id")
    best = rows.groupBy("class_key").agg(F.min(order).alias("best")).select(F.col("best.id").alias("id"))
    gone = rows.select("id").join(best, "id", "left_anti").withColumnRenamed("id", row)
    return tagged.join(gone, row, "left_anti").select(*docs.columns)
