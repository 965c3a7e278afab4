"""Spelling variants against a plain version, signature recall, and the SQL twin."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from issuelens.llm import queries
from issuelens.llm import spelling as S

LOWER = str.maketrans(S.UPPER, S.LOWER)


def plain_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(S.RUN, (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def collected(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    stems = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(4, 8))) for _ in range(40)]
    stems += ["größe", "naïvité", "éclair", "ÿÿÿÿÿ", "street", "streets", "straets", "aaaaa", "aaaaaa", "aaaaaaa"]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("aeinrstö") + w[i:], w[:i] + rng.choice("aeinrstö") + w[i + 1:]])
        return w.upper() if rng.random() < 0.2 and w.isascii() else w

    rows = [(i, " ".join(word() + rng.choice(["", ",", "×", "7", "-"]) for _ in range(rng.randrange(0, 90)))) for i in range(250)]
    return [*rows, (None, "street streets street"), (400, None), (401, ""), (402, "İstanbul ĀĀĀĀĀĀ 中文中文中文"), (403, "street " * 5000), (403, "street " * 5000)]


def test_equals_the_plain_version(spark, texts):
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    n = plain_counts(texts)
    assert {r["word"]: r["n"] for r in S.word_counts(df).collect()} == n
    want = plain_groups(n)
    got = collected(S.spelling_variants(df))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 100
    assert any(v[1] not in (w, v[0]) for w, v in want.items())  # a chain of forms


@pytest.mark.parametrize("parts", [3, 4, 6])
def test_near_words_share_a_signature(parts):
    rng = random.Random(parts)
    for _ in range(3000):
        w = "".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 14)))
        i = rng.randrange(len(w))
        v = rng.choice([w[:i] + rng.choice("abcdeü") + w[i:], w[:i] + rng.choice("abcdeü") + w[i + 1:]])
        if one_edit(w, v):
            shorter, other = sorted((w, v), key=len)
            mine = set(S.word_signatures(shorter, parts)[0])
            assert mine & set(S.word_signatures(other, parts)[len(other) > len(shorter)])


def test_chains_of_forms_are_followed_to_the_end(spark):
    """A chain over 13 words, each with about half of the next one's count."""
    words = [("abcdefghijklmnopq"[:5 + i], 3 * 2 ** i) for i in range(13)]
    got = collected(S.variant_groups(spark.createDataFrame(words, "word string, n bigint")))
    assert {v[1] for v in got.values()} == {words[-1][0]}
    assert got == plain_groups(dict(words))


def test_many_words_with_equal_letters(spark):
    """Anagrams share every multiset signature; only true neighbours come out."""
    rng = random.Random(2)
    words = sorted({"".join(rng.sample("aabbccddee", 10)) for _ in range(3000)})
    rows = [(w, 3 + i % 50) for i, w in enumerate(words)]
    got = S.near_pairs(spark.createDataFrame(rows, "word string, n bigint"))
    assert got.count() == 0  # anagrams differ in two places at least
    more = [*rows, *[(w[:-1], 9) for w in words[:200]]]
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in S.near_pairs(spark.createDataFrame(sorted(set(more)), "word string, n bigint")).collect()}
    all_words = sorted({w for w, _ in more})
    short = [w for w in all_words if len(w) == 9]
    assert pairs == {tuple(sorted((a, b))) for a in short for b in all_words if one_edit(a, b)}


def test_no_join_is_broadcast(spark, texts, monkeypatch):
    # Stored words are small, their signatures are not: Spark would size both by the stored file.
    words = S.stored(spark.createDataFrame([(w, n) for w, n in plain_counts(texts).items()], "word string, n bigint"), "words")
    plans = []
    keep = S.stored

    def planned(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *args)

    monkeypatch.setattr(S, "stored", planned)
    plans.append(S.variant_groups(words)._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not [p for p in plans if "Broadcast" in p]


def test_empty_table_and_clashing_columns(spark, texts):
    schema = "doc_id bigint, text string"
    empty = S.spelling_variants(spark.createDataFrame([], schema))
    assert empty.collect() == []
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    few = spark.createDataFrame(texts[:60], schema)
    more = few.select("*", *[F.lit(1).alias(c) for c in ("word", "run", "h", "n", "sig", "longer", "_w", "root", "form")])
    assert collected(S.spelling_variants(more)) == collected(S.spelling_variants(few))


def test_sql_twin(spark, texts):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts[:200] + texts[-6:])
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    want = con.sql(f"select {', '.join(cols)} from ({queries.SQL['op12_spelling_variants']})").fetchall()
    got = S.spelling_variants(spark.createDataFrame(texts[:200] + texts[-6:], "doc_id bigint, text string"))
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)
