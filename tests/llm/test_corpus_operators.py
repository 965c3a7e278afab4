"""Mixing, packing, near duplicates, line dedup, vector links and the pipeline against plain versions."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import bitmaps, buckets, common, components, line_dedup, minhash, mixing, packing, queries, tokens, vector_links


# --- components -------------------------------------------------------------------------------

@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)],
                                   [(2, 1), (1, 2), (5, 9), (9, 7), (100, 5), (-3, 1)]])
def test_components(spark, edges):
    u = brute.Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {x: u.find(x) for x in u.up}


def test_component_state_of_many_edges(spark):
    edges = spark.range(3 << 23, numPartitions=8).select(F.col("id").alias("b"), (F.col("id") + 1).alias("a"))
    n, *marks = components._state(edges)
    assert n == 3 << 23
    assert marks != list(components._state(edges.withColumn("b", F.when(F.col("b") == 7, 6).otherwise(F.col("b"))))[1:])


# --- mixing -----------------------------------------------------------------------------------

def plain_targets(sizes, share=1.5, cap=2.0):
    """Sources share by weight; what is above a cap is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_mix_targets_and_picks(docs, rows):
    got = mixing.mix_sizes(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(brute.words(t))
    target = plain_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(brute.words(t))) for d, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
        by[r["source"]].append(r)
    for s, rs in by.items():
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        assert all(r["copies"] - epochs in (0, 1) for r in rs)
        # The sample is a prefix in key order, and ends next to the budget.
        rs = sorted((r for r in rs if r["size"]), key=lambda r: (r["key"], r["digest"]))
        extra = [r["copies"] - epochs for r in rs]
        assert extra == sorted(extra, reverse=True)
        assert abs(sum(r["taken"] for r in rs) - target[s]) <= max((r["size"] for r in rs), default=0)


def test_mix_reruns_agree_and_partitions_do_not_matter(docs):
    rows_of = lambda d: sorted(map(repr, mixing.mix_sizes(d).select("doc_id", "size", "copies", "key").collect()))
    assert rows_of(docs) == rows_of(docs.repartition(7))


def test_mixed_documents_follow_the_decisions(clashing, none):
    out = mixing.mix_documents(clashing)
    assert out.columns == clashing.columns
    want = Counter()
    for r in mixing.mix_sizes(clashing).collect():
        want[(r["doc_id"], r["size"])] += r["copies"]
    got = Counter((r["doc_id"], len(brute.words(r["text"]))) for r in out.collect())
    assert got == +want
    assert mixing.mix_documents(none).count() == 0 and mixing.mix_sizes(none).count() == 0


def test_sampling_follows_the_weights():
    rng = np.random.default_rng(3)
    hits = sum((-np.log(rng.random()) / 1.0) < (-np.log(rng.random()) / 0.25) for _ in range(20000))
    assert abs(hits / 20000 - 0.8) < 0.02  # the rule behind the keys: first with probability w / sum of w


# --- packing ----------------------------------------------------------------------------------

def check_packing(rows, got, length):
    """Every id in exactly one piece, sequences gapless and within the length; (sequences, least possible)."""
    encode = tokens.encoder(tokens.vocabulary_path()).text
    want = Counter()
    for d, t in rows:
        data = (encode(t) if t else b"") + np.array([2], "<u4").tobytes()
        for s in range(0, len(data) // 4, length):
            cut = data[4 * s:4 * (s + length)]
            want[(d, s, len(cut) // 4, zlib.crc32(cut), len(data) // 4)] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= length
    return len(seqs), -(-sum(r["length"] for r in got) // length)


def test_packing_round_trip(docs, rows, none):
    got = packing.pack_documents(docs, length=512).collect()
    used, least = check_packing([(r[0], r[1]) for r in rows], got, 512)
    assert used <= 11 / 9 * least + 1  # what first-fit decreasing guarantees
    assert packing.pack_documents(none).count() == 0


def test_first_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 60, rng.integers(1, 80)).tolist()
        where, offset = packing.first_fit_decreasing(sizes, 64)
        bins, plain = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, used in enumerate(bins) if used + sizes[i] <= 64), len(bins))
            if b == len(bins):
                bins.append(0)
            plain[i] = (b, bins[b])
            bins[b] += sizes[i]
        assert [(w, o) for w, o in zip(where, offset, strict=True)] == [plain[i] for i in range(len(sizes))]


def test_groups_are_packed_apart(docs):
    pieces = packing.pieces(docs, length=512).cache()
    got = packing.pack(pieces, 512, group_pieces=20)
    assert got.select((F.col("sequence_id") / (1 << 24)).cast("long")).distinct().count() > 3
    pieces.unpersist()


# --- near duplicates --------------------------------------------------------------------------

def test_signatures_are_unbiased_for_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for trial in range(12):
        d = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
        a = rng.integers(0, 6, 200) * (1 if trial % 3 else 37)
        b = np.where(rng.random(200) < 0.7, a, rng.integers(0, 6, 200) * (1 if trial % 3 else 37))
        sim = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = (minhash.signature(d[a > 0], a[a > 0], 1500) == minhash.signature(d[b > 0], b[b > 0], 1500)).mean()
        errors.append(same - sim)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.03


def test_sketch_bound_holds_for_similar_bags():
    rng = np.random.default_rng(2)
    for n in (9, 90, 900, 9000):
        for _ in range(40):
            d = rng.integers(0, 2 ** 63, n).astype(np.uint64)
            k = n // 10  # 2k occurrences differ: similarity (n - k) / (n + k) > 0.8
            e = np.concatenate([d[k:], rng.integers(0, 2 ** 63, k).astype(np.uint64)])
            one = np.ones(n, np.int64)
            x, y = (np.frombuffer(minhash.odd_sketch(np.sort(v), one), np.uint8) for v in (d, e))
            assert np.bitwise_count(x ^ y).sum() <= minhash.most_bits(np.array([2 * n]), 0.8)[0]


def test_near_classes_equal_all_pairs(docs, rows):
    got = minhash.near_classes(docs).collect()
    texts = [r["text"] for r in docs.select("text").collect()]
    by_key = {}
    for d, t in docs.select(F.xxhash64("text").alias("k"), "text").collect():
        by_key[t] = d
    want = brute.near_classes(texts)
    keys = [by_key[t] for t in texts]
    classes = {k: r for k, r in zip(keys, want, strict=True)}
    groups = defaultdict(set)
    for t, k in zip(texts, keys, strict=True):
        if brute.bag(t):
            groups[classes[k]].add(k)
    expected = {frozenset(g) for g in groups.values()}
    rows_ = docs.select("doc_id", F.xxhash64("text").alias("k")).collect()
    assert len(got) == len(rows_)
    ids = defaultdict(set)
    of = minhash.near_classes(docs.withColumn("k", F.xxhash64("text")), "k").collect()
    for r in of:
        if r["class_key"] is not None:
            ids[r["class_key"]].add(r["id"])
    assert {frozenset(g) for g in ids.values()} == expected


def test_near_duplicate_rows(docs, rows, none, clashing):
    got = minhash.near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert any(r["class_size"] > 1 for r in got)
    kept = minhash.drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    texts = [r["text"] for r in docs.select("text").collect()]
    want = brute.near_classes(texts)
    assert kept.count() == len({c for c, t in zip(want, texts, strict=True) if brute.bag(t)}) + sum(not brute.bag(t) for t in texts)
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_copies(none).count() == 0


def test_a_large_group_of_similar_texts(spark):
    """Copies of one text with many edits: some link, some only look alike."""
    import random
    rng = random.Random(8)
    base = brute.prose(rng, 120).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    want = brute.near_classes([r[1] for r in rows])
    assert [got[i] for i in range(150)] == want


# --- line dedup -------------------------------------------------------------------------------

def test_line_decisions_equal_all_pairs(docs, rows, none):
    got = line_dedup.dropped_lines(docs).collect()
    keep = brute.kept_lines([(r[0], r[1]) for r in rows])
    want = Counter()
    for d, t, *_ in rows:
        full = [i for i, x in enumerate((t or "").split("\n")) if brute.words(x)]
        gone = sorted(set(full) - keep.get((d, t), set()))
        want[(d, len(full), len(gone), tuple(gone))] += 1
    have = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], tuple(sorted(r["dropped"]))) for r in got)
    assert sum(have.values()) == len(rows)
    assert sum((have & want).values()) >= 0.98 * len(rows)  # banding finds a pair at 0.8 with probability 0.997
    assert line_dedup.dropped_lines(none).count() == 0


def test_deduplicated_texts(spark, clashing, none):
    line = "a line of more than a few words that comes back in other documents"
    rows = [(1, f"{line}\n\nown words of the first", "en", "s", 0), (2, f"own words of the second\n{line}!", "en", "s", 0),
            (3, line, "en", "s", 0), (4, None, "en", "s", 0), (5, " \n", "en", "s", 0), (2, f"own words of the second\n{line}!", "en", "s", 0)]
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, brute.SCHEMA)).collect()),
                 key=lambda r: r[0])
    assert got == [(1, rows[0][1], len(rows[0][1])), (2, "own words of the second", 23), (2, "own words of the second", 23), (4, None, None), (5, " \n", 2)]
    out = line_dedup.dedup_lines(clashing)
    assert out.columns == clashing.columns and out.count() > 0
    assert line_dedup.dedup_lines(none).count() == 0


def edited_pairs(kind, n=300):
    """``n`` pairs of lines of one kind at similarity 0.8 or more, an edit or two apart."""
    rng = random.Random(zlib.crc32(kind.encode()))
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = []
    while len(pairs) < n:
        if kind == "unbroken":
            a = "".join(rng.choice(letters) for _ in range(rng.choice((100, 200, 400))))
            at = rng.choice((0, rng.randrange(len(a))))
        else:
            a = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(2, 8)))
            at = rng.choice((0, len(a), rng.randrange(len(a))))
        b = a[:at] + rng.choice("0123456789") + a[at + (at < len(a) and rng.random() < 0.5):]
        x, y = brute.line_shingles(a), brute.line_shingles(b)
        if len(x & y) >= 0.8 * len(x | y):
            pairs.append((a, b))
    return pairs


@pytest.mark.parametrize("kind", ["unbroken", "short"])
def test_similar_lines_share_a_band(spark, kind):
    pairs = edited_pairs(kind)
    lines = spark.createDataFrame([(i, x) for i, p in enumerate(pairs) for x in p], "pair LONG, line STRING")
    by = defaultdict(list)
    for r in line_dedup.with_bands(lines).select("pair", "bands").collect():
        by[r["pair"]].append(set(r["bands"]))
    assert sum(bool(a & b) for a, b in by.values()) >= 0.99 * len(pairs)


def test_similar_lines_share_a_rarest_shingle(spark):
    pairs = edited_pairs("short") + edited_pairs("unbroken") + [("x" * 12, "x" * 40), ("ab", "ab"), ("", "")]
    lines = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "key LONG, line STRING")
    bands = defaultdict(set)
    for r in line_dedup.rarest_shingles(lines, 0.8).collect():
        bands[r["key"]].add(r["band"])
    assert all(bands[2 * i] & bands[2 * i + 1] for i in range(len(pairs)))
    for key, line in lines.collect():
        n = len(brute.line_shingles(line)) or 1
        assert len(bands[key]) == n - -(-4 * n // 5) + 1


def test_ring_is_the_first_hash_after_each_anchor(spark):
    rng = random.Random(9)
    sets = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 5, 36, 40, 700)]
    sets += [[-(1 << 63), (1 << 63) - 1], [-(1 << 63) + (1 << 63) // 36] * 3]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "i LONG, h ARRAY<LONG>")
    for r in line_dedup.with_ring(rows, F.col("h"), "ring").collect():
        s = sorted(r["h"])
        anchors = [-(1 << 63) + (2 * i + 1) * (1 << 63) // 36 for i in range(36)]
        assert r["ring"] == [next((x for x in s if x >= a), s[0]) for a in anchors]


def test_shingles_are_of_code_points(spark):
    lines = ["", "ab", "ten signs!", "eleven sign", "\U0001f600" * 3 + "plain words and \u00e9\u4e2d" + "\U0001f601 more", "x" * 30]
    rows = spark.createDataFrame(list(enumerate(lines)), "i LONG, line STRING")
    got = {r["i"]: r["h"] for r in rows.select("i", line_dedup.shingle_hashes(F.col("line")).alias("h")).collect()}
    for i, x in enumerate(lines):
        assert len(got[i]) == max(1, len(x) - line_dedup.SHINGLE + 1)
        assert len(set(got[i])) == (len(brute.line_shingles(x)) or 1)
    assert set(got[2]).isdisjoint(got[3])


def test_bands_are_of_the_nearest_hashes(spark):
    """Two lines share band b if and only if its anchors' nearest hashes are the same; every shingle counts, the last ones too."""
    pairs = edited_pairs("short", 60) + edited_pairs("unbroken", 30) + [("x" * 12, "x" * 40), ("ab", "ab ")]
    pairs += [("a" * 20 + "bcdefghijk"[:n], "a" * 20 + "bcdefghijk"[:n + 1]) for n in range(9)]
    lines = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "key LONG, line STRING")
    hashes = {r["key"]: r["h"] for r in lines.select("key", line_dedup.shingle_hashes(F.col("line")).alias("h")).collect()}
    got = {r["key"]: r["bands"] for r in line_dedup.with_bands(lines).select("key", "bands").collect()}
    anchors = [-(1 << 63) + (2 * i + 1) * (1 << 63) // 36 for i in range(36)]
    near = {k: [min(x ^ a for x in h) for a in anchors] for k, h in hashes.items()}
    for i in range(len(pairs)):
        a, b = near[2 * i], near[2 * i + 1]
        want = [all(a[(3 * j + s) % 36] == b[(3 * j + s) % 36] for s in (0, 2, 5)) for j in range(12)]
        assert [x == y for x, y in zip(got[2 * i], got[2 * i + 1], strict=True)] == want


def test_equal_lines_are_signed_once_where_they_lie(spark):
    """Signing groups the shingles where the lines were dealt, and neither sorts nor lists them."""
    lines = spark.range(100).select((F.col("id") % 7).alias("h1"), F.concat(F.lit("the line of number "), (F.col("id") % 7).cast("string")).alias("line"))
    one = lines.groupBy("h1").agg(F.first("line").alias("line"))
    signed = line_dedup.with_bands(one, ["h1"])
    assert signed.count() == 7
    plan = signed._jdf.queryExecution().sparkPlan().toString() + signed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "sort_array" not in plan and "transform(" not in plan


def test_early_refusal_changes_no_pair(spark):
    pairs = edited_pairs("short", 40) + edited_pairs("unbroken", 40)
    lines = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "key LONG, line STRING")
    rows = common.stored(line_dedup.sketched(lines, 0.8), "sketches")
    both = rows.select(F.col("key").alias("i"), F.col("sketch").alias("a")).crossJoin(rows.select(F.col("key").alias("j"), F.col("sketch").alias("b")))
    differ = sum((F.bit_count(F.col(f"a.w{k}").bitwiseXOR(F.col(f"b.w{k}"))) for k in range(32)), F.lit(0))
    plain = (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * 0.8 - 1e-6) & (differ <= line_dedup.bits_allowed(F.col("a.n") + F.col("b.n"), 0.8))
    got = both.select("i", "j", line_dedup.near(0.8)("a", "b").alias("got"), plain.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in got)
    assert all(r["got"] for r in got if r["i"] // 2 == r["j"] // 2) and not all(r["got"] for r in got)


def test_shared_buckets_leave_out_lone_keys_before_the_shuffle(spark, monkeypatch):
    rows = spark.range(3000).select(F.xxhash64(F.when(F.col("id") < 2900, F.col("id")).otherwise(F.col("id") % 10)).alias("band"), F.col("id").alias("key"))
    sent = []
    monkeypatch.setattr(buckets, "marked", lambda *a: sent.append(bitmaps.marked(*a)) or sent[-1])
    got = sorted((r["band"], r["key"]) for r in buckets.shared_buckets(rows).collect())
    by = defaultdict(list)
    for r in rows.collect():
        by[r["band"]].append(r["key"])
    assert got == sorted((b, k) for b, x in by.items() if len(x) > 1 for k in x) and got
    assert sent[0].count() < len(got) + 300


def test_marks_find_all_keys_and_few_others(spark):
    lines = spark.range(20000).select(F.xxhash64("id").alias("h1"), "id")
    table, bits = line_dedup.bitmap(lines.filter("id < 1000"), 1000)
    assert set(table.columns) == {"word", "marks"} and table.count() <= bits // line_dedup.WORD
    got = {r["id"] for r in line_dedup.marked(lines, table, bits).collect()}
    assert set(range(1000)) <= got and len(got) < 1000 + 0.15 * 19000


def test_large_buckets_of_unlike_lines(spark, monkeypatch):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = ["https://www.example.com/" + "common/path/of/the/site/" + "".join(rng.choice(letters) for _ in range(30)) for _ in range(1500)]
    near = {1500 + i: 15 * i for i in range(100)}
    lines += [lines[i] + "1" for i in near.values()]
    rows = spark.createDataFrame(list(enumerate(lines)), "key LONG, line STRING")
    monkeypatch.setattr(buckets, "LARGE", 100)
    banded = common.stored(line_dedup.with_bands(rows).select("key", "bands"), "bands")     # a filter is never pushed into the signatures
    tagged = banded.select("key", F.explode("bands").alias("band"), F.col("key").alias("part"))
    assert tagged.groupBy("band").count().agg(F.max("count")).first()[0] > 400

    def pairs(t):
        return t.groupBy("band").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]

    split = buckets.split_buckets(tagged, lambda keys: line_dedup.rarest_shingles(rows.join(keys, "key", "left_semi"), 0.8))
    assert pairs(split) < 0.25 * pairs(tagged)
    left, right = buckets.in_blocks(split)
    assert left.groupBy("band", "low", "high").count().agg(F.max("count")).first()[0] < 2 * buckets.LARGE
    met = left.withColumnRenamed("key", "a").drop("part").join(right.withColumnRenamed("key", "b").drop("part"), ["band", "low", "high"])
    met = {(r["a"], r["b"]) for r in met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct().collect()}
    by = defaultdict(list)
    for r in split.select("band", "key").collect():
        by[r["band"]].append(r["key"])
    assert met == {(a, b) for x in by.values() for a in x for b in x if a < b}
    assert all((a, b) in met for b, a in near.items())
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(lines)], brute.SCHEMA)
    got = {r["doc_id"] for r in line_dedup.dropped_lines(docs).filter("n_dropped = 1").collect()}
    want = brute.kept_lines([(i, x) for i, x in enumerate(lines)])
    assert len(got ^ {i for i, x in enumerate(lines) if (i, x) not in want}) <= 1


def test_sketches_lose_hardly_a_pair():
    assert 0.5 * math.erfc(line_dedup.DEVIATIONS / math.sqrt(2)) < 1e-5


def test_line_operator_runs_no_python(docs):
    plan = line_dedup.dropped_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- vector links -----------------------------------------------------------------------------

def check_links(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT")
    got = Counter(map(tuple, vector_links.link_vectors(df, **options).collect()))
    ok = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    u = brute.Union()
    n = [0] * len(rows)
    for i in ok:
        u.find(i)
        for j in ok:
            a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                n[i] += 1
                u.join(i, j)
    least = {}
    for i in ok:
        if rows[i][0] is not None:
            least[u.find(i)] = min(least.get(u.find(i), rows[i][0]), rows[i][0])
    want = Counter()
    for i, r in enumerate(rows):
        c = least.get(u.find(i)) if i in u.up else r[0]
        want[(r[0], n[i], c, c == r[0])] += 1
    assert got == want


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(120):
        b = rng.standard_normal(16)
        rows.append(b)
        rows.append(b + 0.3 * rng.standard_normal(16))
    rows += [rows[0], rows[0] * 3, rows[5]]
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rows)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [1.0] * 15 + [None], 0),
           (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [float("inf")] * 16, 0), (5, rows[7][1], 0), (908, [1e-200] * 16, 0), (909, [1e200] * 16, 0)]
    check_links(spark, rows + odd)


def test_links_in_small_leaves_blocks_and_dense_balls(spark):
    rng = np.random.default_rng(7)
    ball = rng.standard_normal(32)
    rows = [ball + 0.05 * rng.standard_normal(32) for _ in range(160)]
    for _ in range(160):
        b = rng.standard_normal(32)
        rows += [b, b + 0.25 * rng.standard_normal(32)]
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rows)]
    check_links(spark, rows, leaf_rows=64, block_rows=48)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    assert vector_links.link_vectors(df).count() == 0


# --- queries and pipeline ---------------------------------------------------------------------

def test_every_operator_has_a_query():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, sf_small, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    df = queries.QUERIES[name](spark, sf_small)
    cols = sorted(df.columns)
    got = Counter(norm(r) for r in df.select(*cols).collect())
    rel = con.sql(queries.SQL[name])
    assert sorted(rel.columns) == cols
    assert got == Counter(norm(r) for r in con.sql(f"select {', '.join(cols)} from ({queries.SQL[name]})").fetchall())


def test_pipeline_follows_its_stages(spark, docs, tmp_path):
    import corpus_pipeline
    from issuelens.llm.common import stored
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in step.select("doc_id", "text", "source").collect()]
        step = stored(stage(spark, step, str(tmp_path)), "step")
        seen.append((before, step))
    # Rejected documents go; clean ones stay.
    assert all(not (len(brute.words(t)) < 10) for _, t, _ in seen[1][0])
    # Line dedup: what is left has no two similar lines (but for repeated rows and what banding may miss).
    lines = [x for _, t, _ in set(seen[2][0]) for x in t.split("\n") if brute.words(x)]
    assert len(lines) == len(set(lines))
    # One document of each group of near copies.
    texts = [t for _, t, _ in seen[3][0]]
    assert len(set(brute.near_classes(texts))) == len(texts)
    assert set(seen[3][0]) <= set(seen[2][0])
    # The mix repeats whole documents of its input; the pieces round-trip them.
    mixed = Counter((d, t) for d, t, _ in seen[4][0])
    assert set(mixed) <= {(d, t) for d, t, _ in seen[3][0]} and max(mixed.values()) <= 2
    check_packing([(d, t) for d, t, _ in seen[4][0]], seen[4][1].collect(), packing.SEQUENCE)
    assert Counter(r["ids_crc32"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(
        r["ids_crc32"] for r in seen[4][1].collect())


def test_links_of_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    mean = unit(rng.standard_normal(64))
    x = unit(0.8 ** 0.5 * mean + 0.2 ** 0.5 * unit(rng.standard_normal((3000, 64))))
    off = rng.standard_normal((400, 64))
    off = unit(off - (off * x[:400]).sum(axis=1, keepdims=True) * x[:400])
    x = np.concatenate([x, 0.902 * x[:400] + (1 - 0.902 ** 2) ** 0.5 * off])
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = vector_links.link_vectors(df, leaf_rows=64, block_rows=64).agg(F.sum("n_links")).first()[0]
    assert 0.995 * hit.sum() <= got <= hit.sum()


def test_line_keys_are_independent(spark):
    """Neither half of a line's key, nor of a document's, is a function of the other."""
    rows = spark.createDataFrame([(1, f"line {i}") for i in range(50)], "doc_id bigint, text string")
    got = line_dedup.exploded(rows).select("h1", "h2", "row", F.xxhash64("h1", F.lit(1)).alias("x"), F.xxhash64("line", F.lit(1)).alias("chained")).collect()
    assert len({r["h1"] for r in got}) == len({r["h2"] for r in got}) == len({r["row"] for r in got}) == 50
    # A chained hash seeds with the line's own hash; the second half here does not.
    assert all(r["h2"] not in (r["x"], r["chained"]) for r in got)
    one = rows.select(F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    assert {r["h2"] for r in got} == {r["h2"] for r in one.collect()}


def test_groups_of_unlike_members_stay_bounded(spark, monkeypatch):
    """A bucket of thousands of parts: no group exceeds two blocks, and every pair of parts still meets."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    n = 1500
    sketch = minhash.odd_sketch(*minhash.shingles(b"one two three four five six seven eight", 5))
    tagged = spark.createDataFrame([(1, i, i if i >= 400 else 0) for i in range(n)], "band bigint, key bigint, part bigint")
    sketches = spark.createDataFrame([(i, sketch, 1) for i in range(n)], "key bigint, sketch binary, weight bigint")
    sizes = [r["count"] for r in minhash.meetings(tagged).groupBy("band", "block", "visit").count().collect()]
    assert len(sizes) > 300 and max(sizes) <= 2 * 1.6 * 64
    pairs = minhash.likely_pairs(tagged, sketches, 0.8, best=False)
    assert pairs.count() == n * (n - 1) // 2 - 400 * 399 // 2


def test_text_keys_are_taken_before_lines(docs):
    # Above the generator they would be taken for every line of a text.
    plan = line_dedup.exploded(docs)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate")
    assert "xxhash64(3" in below and "xxhash64(3" not in above


def test_sketches_meet_in_code_that_is_compiled(spark):
    # The JVM does not compile a method of more than 8,000 bytes.
    lines = spark.createDataFrame([(i, f"line number {i} of a few that are alike") for i in range(20)], "key bigint, line string")
    rows = common.stored(line_dedup.sketched(lines, 0.8), "sketches")
    a, b = (rows.select(F.col("key").alias(k), F.col("sketch").alias(f"sketch_{k}"), (F.col("key") % 3).alias(f"m_{k}")) for k in ("a", "b"))
    pairs = a.join(b.hint("merge"), (F.col("m_a") == F.col("m_b")) & (F.col("a") < F.col("b")) & line_dedup.near(0.8)("sketch_a", "sketch_b"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = pairs.select("a", "b").distinct()._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000


def test_stored_steps_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if "shuffle_" in (f := files.apply(i).getName())}

    before = shuffled()
    out = common.stored(spark.range(5000).groupBy((F.col("id") % 500).alias("k")).agg(F.count(F.lit(1)).alias("n")), "counts")
    for _ in range(100):  # files are deleted by a thread of their own
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert out.count() == 500
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
