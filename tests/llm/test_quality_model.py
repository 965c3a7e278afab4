"""Quality classifier: context sums and gradients against plain versions, held-out accuracy, defined results."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import quality_model as M

DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, quality int, toxic int"


def plain_sums(texts):
    dims, signs = M.index_vectors()
    slots = M.Slots()
    sums, counts = {}, {}
    for t in texts:
        s = [slots[w] for w in M.TOKEN.findall(t or "")]
        for i, c in enumerate(s):
            counts[c] = counts.get(c, 0) + 1
            v = sums.setdefault(c, [0] * M.DIM)
            for j in range(max(0, i - M.WINDOW), min(len(s), i + M.WINDOW + 1)):
                if j != i:
                    for d, sign in zip(dims[s[j]], signs[s[j]], strict=True):
                        v[d] += int(sign)
    return {c: (counts[c], sums[c]) for c in counts}


def test_context_sums_equal_the_plain_version(spark, rows, docs, monkeypatch):
    got = {r["slot"]: (r["n"], list(r["vec"])) for r in M.context_sums(docs).collect()}
    assert got == plain_sums([r[1] for r in rows])
    sums = M.ContextSums()
    monkeypatch.setattr(M, "CHUNK", 7)
    slots = M.Slots()
    texts = ["a b c d e f g h i j k!! l", "", "one", "p q " * 30]
    for t in texts:
        sums.text(slots.pieces(t))
    slot, n, vec = sums.rows()
    assert {int(s): (int(c), v.tolist()) for s, c, v in zip(slot, n, vec, strict=True)} == plain_sums(texts)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Some words, some SIGNS!! and 123 numbers; " * 200 + "x" * 500 + " end"
    table = np.random.default_rng(1).normal(size=(M.SLOTS, M.DIM)).astype(np.float32)
    whole = M.Pool(table).text(text)
    monkeypatch.setattr(M, "PIECE", 37)
    monkeypatch.setattr(M, "CHUNK", 5)
    np.testing.assert_allclose(M.Pool(table).text(text), whole, rtol=1e-6, atol=1e-9)
    s = table[[M.Slots()[t] for t in M.TOKEN.findall(text)]].astype(float)
    np.testing.assert_allclose(whole[:M.DIM], s.mean(0), rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose(whole[M.DIM:-1], s.std(0), rtol=1e-5, atol=1e-7)
    np.testing.assert_allclose(whole[-1], (s[1:] * s[:-1]).sum() / (len(s) - 1), rtol=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    params = [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]

    def loss():
        z = np.tanh(x @ params[0] + params[1]) @ params[2] + params[3][0]
        return np.mean(np.logaddexp(0, z) - y * z) + 0.05 * ((params[0] ** 2).sum() + (params[2] ** 2).sum())
    for p, g in zip(params, M.gradients(params, x, y, 0.1), strict=True):
        for i in np.ndindex(p.shape):
            p[i] += 1e-6
            up = loss()
            p[i] -= 2e-6
            down = loss()
            p[i] += 1e-6
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_temperature_calibrates():
    rng = np.random.default_rng(4)
    z = rng.normal(0, 2, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(M.fit_temperature(3 * z, y) - 3) < 0.15
    assert abs(M.fit_temperature(z, y) - 1) < 0.06


def test_held_out_accuracy_and_calibration(spark, sf_small):
    """At sf0.01, on the labels that training never sees."""
    docs = spark.read.parquet(sf_small.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_small.replace("0.001", "0.01") + "/labels.parquet")
    got = M.judge_quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").filter("held_out").select("quality", "score", "predicted").collect()
    assert len(rows) > 40
    right = sum(r["quality"] == r["predicted"] for r in rows) / len(rows)
    constant = max(sum(r["quality"] for r in rows), sum(1 - r["quality"] for r in rows)) / len(rows)
    assert right >= 0.95 and right > constant
    assert abs(sum(r["score"] - r["quality"] for r in rows)) / len(rows) < 0.05


@pytest.fixture(scope="module")
def made(spark):
    good = [(i, f"This is a plain text with number {i} and some more words about things of the day. " * (1 + i % 3)) for i in range(300)]
    bad = [(1000 + i, f"BUY!! NOW!! CHEAP!! DEAL!! {i}!! " * (2 + i % 5)) for i in range(150)]
    rows = [*good, *bad, (5000, None), (5001, ""), (None, "This is a text."), (5002, "\n\t "), (3, good[3][1])]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 0, 0), (9, None, None), (9, 1, 1), (777777, 0, 0)]
    return rows, labels


def scores(spark, rows, labels, parts=3, **kw):
    got = M.judge_quality(spark.createDataFrame(rows, DOCS).repartition(parts), spark.createDataFrame(labels, LABELS), **kw).collect()
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["score"], r["predicted"]) for r in got)


def test_defined_results(spark, made):
    rows, labels = made
    got = scores(spark, rows, labels)
    assert len(got) == len(rows)
    by = {k[1]: (h, s, p) for k, h, s, p in got if not k[0]}
    for i, (held, score, predicted) in by.items():
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == (score >= 0.3)
        assert i >= 5000 or predicted == (i < 1000)
    assert by[5000][1] == by[5001][1] == by[5002][1]
    assert [h for k, h, _, _ in got if k[0]] == [True]
    # Held-out labels never matter, nor do the order and the partitions of the rows.
    flipped = [(i, 1 - q if q is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    assert scores(spark, rows, flipped) == got
    assert [(k, round(s, 9)) for k, _, s, _ in scores(spark, rows[::-1], labels[::-1], parts=1)] == [(k, round(s, 9)) for k, _, s, _ in got]


def test_one_kind_of_label_or_none(spark, made):
    rows, labels = made
    assert {s for _, _, s, _ in scores(spark, rows[:20], [])} == {0.5}
    ones = [x for x in labels if x[1] == 1]
    n = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows[:20])
    assert {s for _, _, s, _ in scores(spark, rows[:20], ones)} == {(n + 1) / (n + 2)}


def test_empty_table_and_clashing_columns(spark, made):
    rows, labels = made
    lab = spark.createDataFrame(labels, LABELS)
    assert M.judge_quality(spark.createDataFrame([], DOCS), lab).collect() == []
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    more = df.select("*", *[F.lit(1).alias(c) for c in ("quality", "_y", "_h", "_id", "x", "h", "y", "score", "slot", "n", "vec", "held_out")])
    want = sorted(map(str, M.judge_quality(df, lab).collect()))
    assert sorted(map(str, M.judge_quality(more, lab).collect())) == want
