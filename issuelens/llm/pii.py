"""Personal data: base patterns, plus candidates judged by boosted trees.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  High-recall
generators then propose further spans, which may overlap: emails with spelled-out
signs, IPv6 addresses, cards with other separators or lengths, phones without a plus.
Every proposal gets features of its format (digits, groups, separators, checksums)
and context (words and characters around it); boosted trees give a calibrated
probability, and the proposals above their kind's threshold become spans, the most
probable first, where they overlap no other span.

The trees are fitted on ``labelled_candidates``: ``n`` rows made by format rules and
a fixed seed (a documented, bounded table), split for fit, calibration and threshold
choice; each kind's threshold is the lowest with precision of at least ``PRECISION``.

Defined results: a null text counts as empty; equal rows get equal spans; an empty table
gives an empty result; extra columns are not looked at.  Texts are read whole; the
patterns run in time linear in the text.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
LABELLED_ROWS = 6000

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a digit run starts: a failed or finished run gives no later start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): the leftmost non-overlapping matches of each kind that pass its test."""
    found = []
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# Generators: (kind, pattern, what must be in the text); each runs in linear time.
AT = r"(?:@|\x20?[\[({](?:at|AT)[\])}]\x20?|\x20at\x20)"
DOT = r"(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?|\x20dot\x20)"
WORD = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++"
GENERATORS = (
    ("email", re.compile(WORD + AT + r"[A-Za-z0-9-]++(?:" + DOT + r"[A-Za-z0-9-]++)++"), ("@", "at", "AT")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}(?:::|:[0-9A-Fa-f]{1,4}:))(?:[0-9A-Fa-f]{1,4})?(?:::?[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![0-9A-Za-z:])"), (":",)),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])"), (".",)),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[\x20./_-]{0,2}[0-9]{2,6}){2,5}(?![0-9A-Za-z])"), ()),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"), ()),
)
HAS_DIGIT = re.compile(r"[0-9]")

GOOD_WORDS = {
    "email": ("mail", "email", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "mastercard", "payment", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell"),
}
BAD_WORDS = ("version", "release", "isbn", "order", "invoice", "page", "pages", "section", "date", "build", "row",
             "total", "ratio", "figure", "serial", "years", "score", "chapter")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "ch", "us")
CONTEXT = 32


def candidates(text: str) -> list[tuple[str, int, int]]:
    digits = HAS_DIGIT.search(text) is not None
    return [(kind, *m.span()) for kind, pattern, needs in GENERATORS
            if (needs and any(n in text for n in needs)) or (not needs and digits)
            for m in pattern.finditer(text)]


def colon_address(s: str) -> bool:
    """Is ``s`` an address of eight hexadecimal groups, with one stretch of zeros left out at most?"""
    try:
        return ":" in s and ipaddress.ip_address(s).version == 6
    except ValueError:
        return False


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    d = digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    letters = sum(c.isalpha() for c in s)
    before = text[max(0, start - CONTEXT):start].lower()
    words = re.findall(r"[a-z]+", before)[-4:]
    prev, nxt = text[start - 1:start], text[end:end + 1]
    host = re.split(r"(?:\.|dot|\])", s)[-1].strip(" ])")
    tail = s.rsplit(".", 1)[-1]
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(d)), float(letters), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(len(groups[-1]) if groups else 0),
        float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("/")), float(s.count(":")),
        float("(" in s and ")" in s), float("@" in s), float("at" in s.lower().split("@")[0] and "@" not in s),
        float("dot" in s.lower()), float("[" in s or "{" in s or "(a" in s.lower() or "(d" in s.lower()),
        float(13 <= len(d) <= 19 and luhn(d)), float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(d[:1] == "0"), float(d[:1] in "3456" if d else 0), float(len(set(map(len, groups))) <= 1),
        float(any(w in GOOD_WORDS[kind] for w in words)), float(any(w in BAD_WORDS for w in words)),
        float(prev.isalnum()), float(nxt.isalnum()), float(prev in "#$€£=v" if prev else 0), float(nxt in "%$€£" if nxt else 0),
        float(host.isalpha() and 2 <= len(host) <= 6), float(tail.isalpha()), float(host in TOP_DOMAINS),
        float(colon_address(s)),
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-/. ][0-1]?[0-9][-/. ][0-3]?[0-9].*", s))),
    ]


def labelled_candidates(n: int = LABELLED_ROWS, seed: int = 3) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): ``n`` candidates in made-up sentences, by format rules."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    syl = ("an", "the", "ou", "ing", "re", "li", "mo", "sta", "ver", "ke", "no", "pa", "tion")
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    def card():
        body = rng.choice("3456") + num(rng.choice((12, 13, 14)))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(("", " ", "-", ".", " ", "/"))
        return sep.join(body[i:i + 4] for i in range(0, len(body), 4))

    def octet():
        return str(rng.randint(0, 255) if rng.random() < 0.8 else rng.randint(0, 9))

    def names():
        return "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))

    def group(size=None):
        return "".join(rng.choice("0123456789abcdef") for _ in range(size or rng.randint(1, 4)))

    def good():
        kind = rng.choice(KINDS)
        if kind == "email":
            at = rng.choice(("@", " [at] ", "[at]", " (at) ", " at ", "(at)"))
            dot = rng.choice((".", " [dot] ", "[dot]", " (dot) ", " dot ")) if at != "@" else rng.choice((".", " dot ", "[dot]"))
            return kind, f"{word()}{rng.choice(('.', '_', ''))}{num(rng.randint(0, 2))}{at}{word()}{rng.choice(('', num(1)))}{dot}{rng.choice(TOP_DOMAINS)}"
        if kind == "ip":
            form = rng.random()
            if form < 0.25:
                return kind, ":".join(group(4) for _ in range(8))
            if form < 0.5:  # zeros left out
                front, back = rng.randint(0, 3), rng.randint(1, 4)
                return kind, ":".join(group() for _ in range(front)) + "::" + ":".join(group() for _ in range(back))
            return kind, rng.choice((".", "[.]", ".")).join(octet() for _ in range(4))
        if kind == "card":
            return kind, card()
        a, b, c = num(3), num(3), num(4)
        return kind, rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0049 {a} {b} {c}", f"001-{a}-{b}-{c}"))

    def bad():
        pick = rng.randint(0, 8)
        if pick == 0:
            return "card", rng.choice(("", " ", "-", ".", "/")).join(num(rng.randint(3, 5)) for _ in range(rng.randint(3, 5)))
        if pick == 1:
            return "phone", rng.choice((f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
                                        f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1900, 2030)}"))
        if pick == 2:
            return "phone", f"{num(2)}-{num(2)}-{num(3)}"
        if pick == 3:
            return "ip", rng.choice((":".join(num(2) for _ in range(3)), f"{num(1)}::{word()}", f"::{group(8)}", f"{names()}::{names()}"))
        if pick == 4:
            return "email", f"{word()} at {word()}.{word().capitalize()}"
        if pick == 5:
            return "email", f"{word()} at {word()} dot {word()}{word()}"
        if pick == 6:
            return "phone", " ".join(num(rng.randint(2, 3)) for _ in range(rng.randint(3, 5)))
        if pick == 7:
            return "card", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"
        return "ip", ".".join(str(rng.randint(0, 999)) for _ in range(4))

    rows = []
    while len(rows) < n:
        label = int(rng.random() < 0.5)
        kind, s = good() if label else bad()
        hint = rng.random()
        lead = ""
        if hint < 0.35:
            lead = rng.choice(GOOD_WORDS[kind] if label or hint < 0.03 else BAD_WORDS) + rng.choice((" ", ": ", " no "))
        left = " ".join(word() for _ in range(rng.randint(0, 5))) + " " + lead
        text = left + s + rng.choice((" ", ". ", ", ", "### ", "\n", "")) + " ".join(word() for _ in range(3))
        for k, a, b in candidates(text):
            if k == kind and a < len(left) + len(s) and b > len(left):
                # A proposal is right if it covers the planted string and adds little to it.
                same = label and abs(a - len(left)) <= 1 and abs(b - len(left) - len(s)) <= 1
                rows.append((text, k, a, b, int(same)))
                break
    return rows


class Judge:
    """The fitted trees and each kind's threshold."""

    def __init__(self, rows: int = LABELLED_ROWS, precision: float = PRECISION, seed: int = 3):
        data = labelled_candidates(rows, seed)
        x = np.array([features(*r[:4]) for r in data])
        y = np.array([r[4] for r in data], float)
        n = rows * 3 // 4
        self.model = boosting.fit(x[:n], y[:n])
        p, kinds = self.model.probability(x[n:]), x[n:, 0]
        self.thresholds = {k: max(0.5, boosting.threshold_for(p[kinds == i], y[n:][kinds == i], precision))
                           for i, k in enumerate(KINDS)}
        self.held_out = float(((p >= 0.5) == (y[n:] > 0)).mean())

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans to add to ``base``: most probable first, none overlapping another span."""
        kept = Disjoint(base)
        proposed = [c for c in candidates(text) if kept.free(c[1], c[2])]
        if not proposed:
            return []
        p = self.model.probability(np.array([features(text, *c) for c in proposed]))
        taken, spans = Disjoint([]), []
        for i in np.lexsort((np.arange(len(p)), -p)):
            kind, a, b = proposed[i]
            if p[i] >= self.thresholds[kind] and taken.free(a, b):
                taken.add(a, b)
                spans.append((kind, a, b, float(p[i])))
        return spans


class Disjoint:
    """Taken stretches of a text, kept apart and in order, so that a test is a binary search."""

    def __init__(self, spans: list):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:  # base spans of two kinds may overlap
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


@lru_cache(maxsize=1)
def judge() -> Judge:
    """Fitted once per worker process, always from the same rows."""
    return Judge()


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


def spans_of(text: str, judge_: Judge) -> list[tuple[str, int, int, bool, float]]:
    """All spans by start, then kind."""
    base = base_spans(text)
    every = [(k, a, b, True, 1.0) for k, a, b in base] + [(k, a, b, False, p) for k, a, b, p in judge_.added(text, base)]
    return sorted(every, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``; with_text adds the redacted text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = judge()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            spans = [spans_of(t, j) for t in texts]
            keys = ("kind", "start", "end", "base", "score")
            columns = [b.column(0), pa.array([[dict(zip(keys, s, strict=True)) for s in x] for x in spans], pa.list_(SPAN))]
            if with_text:
                columns.append(pa.array([redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "redacted"][:len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"
             + (", redacted string" if with_text else ""))
