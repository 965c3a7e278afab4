"""Plain versions of the operators for small inputs, and the documents they are tried on."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    syl = ("an", "the", "ou", "ing", "re", "li", "mo", "sta", "ver", "ke", "no", "pa", "tion", "é", "ü")
    out = []
    for _ in range(n):
        w = "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
        out.append(w + rng.choice(("", "", "", "", ",", ".", ".\n")))
    return " ".join(out).replace("\n ", "\n")


def documents(seed=1, n=60):
    """Rows with nulls, blanks, ties, repeated rows, near copies and one long text."""
    rng = random.Random(seed)
    rows = []

    def add(text, source=None, lang="en", doc_id=0):
        i = len(rows) if doc_id == 0 else doc_id
        rows.append((i, text, lang, source if source != "null" else None, None if text is None else len(text)))

    add("first text that is short", "a")
    base = [prose(rng, rng.randint(40, 200)) for _ in range(n)]
    for i, t in enumerate(base):
        add(t, rng.choice(("a", "b", "b", "b", "null")), rng.choice(("en", "en", "de")))
        if i % 6 == 0:
            add(t, "c")                                   # exact copy
        if i % 5 == 0:
            w = t.split(" ")
            w[len(w) // 2] = "changed"
            add(" ".join(w), "b")                         # near copy
        if i % 9 == 0:
            add(base[0].split("\n")[0] + "\n" + t, "a")   # shared line
    add(None, "a")
    add("", "b")
    add(" \t\n \n", None)
    add("word", "a")
    add("spam %%% ### $$$ *** " * 30, "b")
    add("again and again and " * 30, "b")
    add(prose(rng, 9000), "b", "de")                      # very long
    rows.append(rows[3])                                  # repeated row
    rows.append((None, "a row without an id but with more than ten words in its text, plainly", None, "a", 9))
    return rows


def bag(text, k=5):
    w = (text or "").encode().split()
    k = min(k, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_classes(texts, threshold=0.8):
    """Least index of each text's class; a text without words is alone."""
    u, bags = Union(), [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= threshold:
                u.join(i, j)
    return [u.find(i) for i in range(len(texts))]


def line_shingles(line, k=10):
    return {line} if len(line) < k else {line[i:i + k] for i in range(len(line) - k + 1)}


def kept_lines(rows, threshold=0.8):
    """{(doc_id, text): numbers of its kept lines} for rows of (doc_id, text)."""
    lines = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for at, line in enumerate((t or "").split("\n")):
            if words(line):
                lines.setdefault(line, []).append(((d is not None, d or 0), (d, t), at))
    keys = list(lines)
    sets, u = [line_shingles(x) for x in keys], Union()
    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                u.join(i, j)
    first = {}
    for i, key in enumerate(keys):
        place = min(lines[key], key=lambda p: (p[0], p[2]))
        c = u.find(i)
        if c not in first or (place[0], place[2]) < (first[c][0], first[c][2]):
            first[c] = place
    out = {}
    for _, row, at in first.values():
        out.setdefault(row, set()).add(at)
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    full = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(covered)
