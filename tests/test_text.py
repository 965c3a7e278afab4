"""Text predicates, cleaners and counters on hand-made rows (FIXTURES 4)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from issuelens.functions import patterns as P
from issuelens.functions import text as T


def _eval(spark, col_fn, values):
    df = spark.createDataFrame([(v,) for v in values], "x STRING")
    return [r[0] for r in df.select(col_fn(F.col("x"))).collect()]


def test_log_as_written(spark):
    cases = ["ERROR: boom", "\n        ERROR: boom", "Backtrace:", "blogs:", "10:20:30", "plain text"]
    assert _eval(spark, T.has_log, cases) == [False, True, True, True, True, False]


def test_log_intended_plain_level(spark):
    assert _eval(spark, lambda c: T.has_log(c, as_written=False), ["ERROR: boom"]) == [True]


def test_remove_url(spark):
    assert _eval(spark, T.remove_url, ["# a **b** __c__ [t](u)"]) == [" a b c t"]


def test_remove_markdown_greedy_links_and_arrow(spark):
    assert _eval(spark, T.remove_markdown, ["x [a](b) mid [c](d) y", "a --> b"]) == ["x   y", "a    b"]


def test_keyword_count_with_empty_alternative(spark):
    pat = P.keyword_pattern("issue|doc|api|", as_written=True)
    assert _eval(spark, lambda c: T.regex_count(c, pat), ["", "hello", "api doc"]) == [1, 6, 4]


@pytest.mark.parametrize("pattern,text,expected", [
    (P.CODE_MARK, "```x``` ``````", 5),
    (P.ISSUE_REFERENCE, " #1 #2 #3 ", 2),
    (P.USERNAME, " @a hi @b there \n", 1),
])
def test_handmade_counters(spark, pattern, text, expected):
    assert _eval(spark, lambda c: T.regex_count(c, pattern), [text]) == [expected]


def test_code_block_and_log_fences(spark):
    text = "a\n```\nlet x = 1;\n```\nb\n```\n2024-01-02 03:04:05 ERROR: boom\n```\n"
    assert _eval(spark, T.has_code_block, [text]) == [True]
    cleaned = _eval(spark, T.remove_code_block, [text])[0]
    assert "let x" not in cleaned and "03:04:05" in cleaned
    assert _eval(spark, T.remove_code_block, [cleaned]) == [cleaned]  # idempotent
    no_log = _eval(spark, T.remove_log, [text])[0]
    assert "03:04:05" not in no_log and "let x" in no_log


def test_decode_thresholds_strict_vs_inclusive(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2],)], "s ARRAY<DOUBLE>")
    r = df.select(T.decode("s", 0.5, strict=True).alias("logit"),
                  T.decode("s", 0.5, strict=False).alias("prob")).first()
    assert (r["logit"], r["prob"]) == (-1, 0)


def test_softmax_and_label_name(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0], -1), ([0.0, 2.0, 0.0], 1)], "s ARRAY<DOUBLE>, p INT")
    rows = df.select(T.softmax("s").alias("sm"), T.label_name("p", ("feature", "bug", "doc")).alias("n")).collect()
    assert rows[0]["sm"] == pytest.approx([1 / 3] * 3)
    assert rows[0]["n"] is None and rows[1]["n"] == "bug"
    # double softmax never exceeds e/(e+2)
    d = df.select(T.double_softmax("s").alias("d")).collect()
    assert max(max(r["d"]) for r in d) <= 2.718281828 / (2.718281828 + 2) + 1e-9


def test_external_encoder_nan_mean(spark):
    import numpy as np

    from issuelens.operators import vectors

    def make():
        def predict(texts):
            out = []
            for t in texts:
                n = float(len(t))
                out.append([n, float(t.count("a"))] if n > 3 else [float("nan"), float("nan")])
            return np.array(out, dtype=np.float32)
        return predict

    encode = vectors.batch_encoder(make, dim=2, batch_size=2)
    df = spark.createDataFrame([(1, "aaaa bb. cc. dddd aa! "), (2, "ab. "), (3, "")], "id BIGINT, t STRING")
    got = {r["id"]: r["vector"] for r in vectors.encoded_sentence_mean(df, F.col("t"), encode, 2).collect()}
    # sentences of 1: "aaaa bb" (7, 4), "cc" (nan), "dddd aa" (7, 2) -> mean (7, 3)
    assert got[1] == pytest.approx([7.0, 3.0])
    assert got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


@pytest.mark.parametrize("pattern,text,expected", [
    # Values of the reference's patterns, whose blanks and digits are Unicode.
    (P.ISSUE_REFERENCE, "\u00a0#12\u00a0", 1),
    (P.ISSUE_REFERENCE, " #\u0663 ", 1),
    (P.USERNAME, "\u2003@a b", 1),
    (P.USERNAME, "\x0b@a\x0b", 1),
    (P.LINK, "\x85[a](b)\u3000", 1),
])
def test_counters_take_unicode_blanks_and_digits(spark, pattern, text, expected):
    assert _eval(spark, lambda c: T.regex_count(c, pattern), [text]) == [expected]


def test_upper_case_numerals_count(spark):
    import re
    words = ["\u2167", "\u2177", "\u00c9t\u00e9", "\u01c5x", "abc", "X9"]
    assert _eval(spark, lambda c: c.rlike(P.UPPER_INITIAL), words) == [w[0].isupper() for w in words]
    assert re.match(r"\w", "\u2167")


def test_markdown_links_of_issue_text(spark):
    text = "see [a](http://x/1)[b](</y z>) ![i](img.png) `[c](d)` <https://z.org/q> [e](f \"t\")\n```\n[g](h)\n```\n"
    assert _eval(spark, T.extract_markdown_links, [text]) == [["http://x/1", "/y z", "https://z.org/q", "f"]]


def test_reference_style_and_nested_links(spark):
    text = ("[a](http://x/1) [The Guide][Doc] [doc][] [doc] [none] [x][none] ![i][doc] [![b](i.png)](http://ci/z) <https://z.org/q> `[doc]`\n"
            "[DOC]: <http://d/1> \"title\"\n[doc]: http://d/2\n```\n[doc]\n```\n")
    want = ["http://x/1", "http://d/1", "http://d/1", "http://d/1", "http://ci/z", "https://z.org/q"]
    assert _eval(spark, T.extract_rendered_links, [text, "", None, "[ ] [x] to do"]) == [want, [], [], []]
