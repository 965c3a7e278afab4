"""Text cleaners, predicates, tokenisers and hand-made counts as Column
expressions (F1-F10, F12, F18, P5, P9-P12).

Everything here is a built-in Spark expression, so it runs in the JVM over whole
texts; no Python runs per row.  Regex functions are code-generated; higher-order
array functions (``filter``, ``transform``, ``exists``, ``aggregate``) are interpreted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_count(c, pattern: str) -> Column:
    """Non-overlapping matches, scanning left to right (``len(findall)``)."""
    return F.regexp_count(_col(c), F.lit(pattern))


def regex_all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))


# --- predicates (P10-P12) ---------------------------------------------------

def has_log(c, as_written: bool = True) -> Column:
    """P10: any log marker (Q1: as written, level/Traceback markers need a
    preceding newline and eight spaces)."""
    return _col(c).rlike(P.log_pattern(as_written))


def code_blocks(c) -> Column:
    """Every ``` fenced block (across lines), in order."""
    return regex_all(c, P.FENCE)


def has_code_block(c, as_written: bool = True) -> Column:
    """Some fence that does not carry a log."""
    return F.exists(code_blocks(c), lambda b: ~b.rlike(P.log_pattern(as_written)))


def has_url(c) -> Column:
    """An http(s) URL occurs."""
    return _col(c).rlike(P.URL)


# --- cleaners (F1-F4) -----------------------------------------------------------

def _remove_blocks(c, keep_if_log: bool, as_written: bool) -> Column:
    log = P.log_pattern(as_written)
    blocks = F.filter(code_blocks(c), (lambda b: ~b.rlike(log)) if keep_if_log else (lambda b: b.rlike(log)))
    return F.aggregate(blocks, _col(c), lambda acc, b: F.replace(acc, b, F.lit("")))


def remove_code_block(c, as_written: bool = True) -> Column:
    """delete every fence without a log (each found fence text replaced
    everywhere, one after the other)."""
    return _remove_blocks(c, keep_if_log=True, as_written=as_written)


def remove_log(c, as_written: bool = True) -> Column:
    """delete fences that carry a log.  As written (Q2) the removal of log
    lines outside fences is a no-op; ``as_written=False`` also removes them."""
    out = _remove_blocks(c, keep_if_log=False, as_written=as_written)
    if not as_written:
        out = F.regexp_replace(out, P.log_line_pattern(False), "")
    return out


def remove_url(c) -> Column:
    """drop ``__``, ``*``, ``#``; unwrap ``[t](u)`` to ``t``; delete URLs (Q12)."""
    unwrapped = F.regexp_replace(_col(c), P.MARKDOWN_EMPHASIS_OR_LINK, "$1")
    return F.regexp_replace(unwrapped, P.URL, "")


def remove_markdown(c) -> Column:
    """each markdown token becomes one space (Q13: greedy links)."""
    return F.regexp_replace(_col(c), P.MARKDOWN, " ")


CLEANERS: dict[str, Callable[[Column], Column]] = {
    "remove_code_block": remove_code_block,
    "remove_log": remove_log,
    "remove_url": remove_url,
    "remove_markdown": remove_markdown,
}

TRAINER_STEPS = ("remove_url", "remove_log")
LABELLER_STEPS = ("remove_code_block", "remove_url")


def clean(c, steps: Sequence[str | Callable[[Column], Column]] = TRAINER_STEPS) -> Column:
    """apply cleaners in order; builds one nested expression."""
    out = _col(c)
    for step in steps:
        fn = CLEANERS[step] if isinstance(step, str) else step
        out = fn(out)
    return out


# --- assembly helpers (P5, P9, F7-F9) ------------------------------------------

def concat_features(columns: Sequence[str] = ("title", "body"), trailing: bool = True) -> Column:
    """P5: ``title + ' ' + body + ' '`` (trainer); ``trailing=False`` gives the
    labeller's ``title + ' ' + body``.  Nulls read as empty text (Q19)."""
    parts: list[Column] = []
    for i, name in enumerate(columns):
        if i:
            parts.append(F.lit(" "))
        parts.append(F.coalesce(F.col(name), F.lit("")))
    if trailing:
        parts.append(F.lit(" "))
    return F.concat(*parts)


def issue_number(url) -> Column:
    """Last path piece of the issue URL as a number."""
    return F.substring_index(_col(url), "/", -1).cast("bigint")


def split_code_text(body) -> Column:
    """struct of all fences and the text without them."""
    return F.struct(code_blocks(body).alias("codeblocks"),
                    F.regexp_replace(_col(body), P.FENCE, "").alias("text"))


def extract_links(html) -> Column:
    """F8: link targets of rendered HTML."""
    return regex_all(html, P.HTML_LINK, 1)


def extract_markdown_links(text) -> Column:
    """F8 on issue text: targets of the links that rendering would make, in order;
    images, and links inside fences or code spans, are none."""
    rendered = F.regexp_replace(F.regexp_replace(_col(text), P.FENCE, ""), P.CODE_SPAN, "")
    found = F.filter(regex_all(rendered, P.MARKDOWN_LINK), lambda m: ~m.startswith("!"))
    return F.transform(found, lambda m: F.concat(*[F.regexp_extract(m, P.MARKDOWN_LINK, i) for i in (1, 2, 3)]))


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def extract_rendered_links(text) -> Column:
    """F8 on issue text, reference-style links included: ``[text][label]``, ``[label][]`` and
    ``[label]`` take the target that the text's first line ``[label]: target`` gives, whatever the case of A-Z;
    without one they are no links.  An image inside a link's text does not hide the link.  An empty
    array for a null text."""
    rendered = F.regexp_replace(F.regexp_replace(_col(text), P.FENCE, ""), P.CODE_SPAN, "")
    plain = F.translate(rendered, ASCII_UPPER, ASCII_LOWER)
    labels, targets = regex_all(plain, P.LINK_DEFINITION, 1), regex_all(rendered, P.LINK_DEFINITION, 2)
    shown = F.regexp_replace(F.regexp_replace(rendered, P.LINK_DEFINITION, ""), P.MARKDOWN_IMAGE, "")

    def target(m: Column, known: Column) -> Column:
        part = [F.regexp_extract(m, P.ANY_LINK, i) for i in range(1, 6)]
        given = F.concat(part[1], part[2], part[4])
        label = F.translate(F.when(part[3] != "", part[3]).otherwise(part[0]), ASCII_UPPER, ASCII_LOWER)
        place = F.array_position(known["labels"], label).cast("int")
        return F.when(given != "", given).when(place > 0, F.get(known["targets"], place - 1)).otherwise(F.lit(""))

    both = F.struct(labels.alias("labels"), targets.alias("targets"))
    found = bound(both, lambda known: F.transform(regex_all(shown, P.ANY_LINK), lambda m: target(m, known)))
    return F.coalesce(F.filter(found, lambda t: t != ""), F.array().cast("array<string>"))


def html_to_text(html) -> Column:
    """images become `` IMAGE_TOKEN ``, then tags are stripped (entities kept)."""
    return F.regexp_replace(F.regexp_replace(_col(html), P.HTML_IMG, P.IMAGE_TOKEN), P.HTML_TAG, "")


# --- tokenisers (F10, F18) -----------------------------------------------------

def tokens(c, lower: bool = False) -> Column:
    """F10 (a)/(b): word tokens, optionally lower-cased."""
    src = F.lower(_col(c)) if lower else _col(c)
    return regex_all(src, P.WORD)


def vector_tokens(c) -> Column:
    """F10 (c): contractions, hyphenated words, words and punctuation."""
    return regex_all(c, P.VECTOR_TOKEN)


def sentence_split(c) -> Column:
    """sentences split at runs of . ! ? followed by blanks; empty pieces
    dropped (a rule, not a trained sentence model)."""
    return F.filter(F.split(_col(c), P.SENTENCE_END), lambda s: F.length(s) > 0)


# --- hand-made features (F12) ----------------------------------------------------

HANDCRAFTED_NAMES = ("title_length", "text_length", "n_codeblocks", "distinct_words",
                     "upper_words", "usernames", "issue_references", "links", "images",
                     "code_marks", "asterisks", "underscores", "hashes")


def handcrafted_features(title, text, codeblocks, lower: bool = False) -> Column:
    """the 13 counts.  As written (Q6) distinct words are case-sensitive;
    Q16: the third value is the number of fences."""
    words = tokens(text, lower=lower)
    values = [
        F.length(_col(title)), F.length(_col(text)), F.size(_col(codeblocks)),
        F.size(F.array_distinct(words)),
        F.size(F.filter(tokens(text), lambda w: w.rlike(P.UPPER_INITIAL))),
        regex_count(text, P.USERNAME), regex_count(text, P.ISSUE_REFERENCE),
        regex_count(text, P.LINK), regex_count(text, P.IMAGE), regex_count(text, P.CODE_MARK),
        regex_count(text, P.ASTERISK), regex_count(text, P.UNDERSCORE), regex_count(text, P.HASH),
    ]
    return F.array(*[v.cast("int") for v in values])


# --- scores and decoding (T7, F13-F17) ------------------------------------------

def bound(value: Column, expression: Callable[[Column], Column]) -> Column:
    """``expression`` over ``value``, which is evaluated once however often the expression
    reads it: it is bound to a lambda's variable."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def argmax(scores) -> Column:
    """Index of the largest score, first one on ties."""
    return bound(_col(scores), lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def decode(scores, threshold: float, strict: bool) -> Column:
    """F15 (``strict``: max > c, logits) / F16 (max >= t, probabilities);
    otherwise -1 = abstain (Q11)."""
    def decide(s: Column) -> Column:
        passed = F.array_max(s) > F.lit(threshold) if strict else F.array_max(s) >= F.lit(threshold)
        return F.when(passed, (F.array_position(s, F.array_max(s)) - 1).cast("int")).otherwise(F.lit(-1))

    return bound(_col(scores), decide)


def softmax(scores) -> Column:
    """numerically stable softmax of an array of scores."""
    def shares(e: Column) -> Column:
        return bound(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))

    def powers(s: Column) -> Column:
        return bound(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp(x - m)))

    return bound(_col(scores).cast("array<double>"), lambda s: bound(powers(s), shares))


def double_softmax(scores) -> Column:
    """Q9: the trainer's softmax applied to an already-softmaxed output."""
    return softmax(softmax(scores))


def l2_normalise(v) -> Column:
    """v / ||v||, unchanged when the norm is 0."""
    def divided(arr: Column) -> Column:
        length = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x))
        return bound(length, lambda norm: F.when(norm > 0, F.transform(arr, lambda x: x / norm)).otherwise(arr))

    return bound(_col(v).cast("array<double>"), divided)


def label_name(pred, names: Sequence[str | None]) -> Column:
    """class code -> configured label text; abstain (-1) -> NULL (Q10)."""
    mapping = F.create_map(*[x for i, n in enumerate(names) if n is not None
                             for x in (F.lit(i), F.lit(n))])
    return F.try_element_at(mapping, _col(pred))
