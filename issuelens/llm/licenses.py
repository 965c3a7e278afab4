"""License scan by ordered signature rules.

Rules are regular expressions over the word stream of a text (A-Z lower-cased, words
of ASCII letters, digits and non-ASCII characters, joined by one blank), made from
the table of licenses times the table of phrasings: some hundreds, in order of
priority.  A rule is tried only if its keywords are among the words of the text.  Its
detections are word intervals; they are accepted in rule order, and one that lies
inside an accepted interval is suppressed, so ``cc by nc sa`` does not also count as
``cc by``.

Defined results: a null or empty text has no words and no detections; equal rows get
equal results; an empty table gives an empty result; extra columns are not looked at.
Texts are read whole, whatever their length, and no rows are shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Word rule: A-Z to a-z, other ASCII characters that are not digits or letters are blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

# Phrases whose places are always reported: (label, words).
BASE_PHRASES = (
    ("mit", b"under the mit license"),
    ("apache-2", b"apache license version 2"),
    ("cc-by-nc", b"cc by nc"),
)

# Licenses: (label, keyword, names as they stand in the word stream).
LICENSES = (
    ("cc-by-nc-nd", "nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|no ?derivatives|noderivs)"),
    ("cc-by-nc-sa", "sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|share ?alike)"),
    ("cc-by-nc", "nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)"),
    ("cc-by-nd", "nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|no ?derivatives|noderivs)"),
    ("cc-by-sa", "sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", r"(?:cc by|creative commons attribution)(?: [1-4] 0)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?v?3?(?: 0)?(?: only| or later)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2(?: 1| 0)?(?: only| or later)?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public(?: licen[sc]e)?(?: version| v)? ?2(?: 1)?"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public(?: licen[sc]e)?(?: version| v)? ?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gnu", r"gnu general public(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gnu", r"gnu general public(?: licen[sc]e)?(?: version| v)? ?3(?: 0)?"),
    ("gpl", "gnu", r"gnu general public"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?: 1 [1-3])?"),
    ("gfdl", "documentation", r"gnu free documentation"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)? 1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd", r"0bsd"),
    ("0bsd", "zero", r"zero clause bsd"),
    ("mit-0", "0", r"mit 0"),
    ("mit", "mit", r"mit(?: x11)?"),
    ("x11", "x11", r"x11"),
    ("isc", "isc", r"isc"),
    ("mpl-1.1", "mpl", r"mpl ?v?1(?: 1| 0)"),
    ("mpl-2", "mpl", r"mpl ?v?2(?: 0)?"),
    ("mpl-2", "mozilla", r"mozilla public(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("epl-1", "epl", r"epl ?v?1(?: 0)?"),
    ("epl-2", "epl", r"epl ?v?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cpl", "cpl", r"cpl(?: 1 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-2", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic"),
    ("boost-1", "boost", r"boost software"),
    ("boost-1", "bsl", r"bsl 1 0"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: 1 1)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font"),
    ("eupl", "eupl", r"eupl(?: 1 [0-2])?"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("odbl", "database", r"open (?:data commons open )?database"),
    ("odc-by", "odc", r"odc by(?: 1 0)?"),
    ("pddl", "pddl", r"pddl(?: 1 0)?"),
    ("psf-2", "psf", r"psf(?: 2 0)?"),
    ("psf-2", "python", r"python software foundation"),
    ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa"),
    ("afl-3", "afl", r"afl(?: 3 0)?"),
    ("osl-3", "osl", r"osl(?: 3 0)?"),
    ("ecl-2", "ecl", r"ecl(?: 2 0)?"),
    ("unicode", "unicode", r"unicode(?: dfs)?"),
    ("w3c", "w3c", r"w3c(?: software)?"),
    ("ijg", "ijg", r"ijg"),
    ("vim", "vim", r"vim"),
    ("ruby", "ruby", r"ruby"),
    ("php-3", "php", r"php(?: 3 0[01]?)?"),
)

# Phrasings in order of priority: (name, weight, keywords of which one must occur, form).
PHRASINGS = (
    ("identifier", 1.0, ("spdx",), r"spdx license identifier {name}"),
    ("granted", 0.95, ("licensed", "licenced", "distributed", "released", "available", "published"),
     r"(?:licen[sc]ed|distributed|released|available|published) under (?:the )?(?:terms of (?:the )?)?{name}(?: (?:public )?licen[sc]e)?(?: version [0-9]+(?: [0-9])?)?"),
    ("subject", 0.9, ("subject", "terms", "conditions"),
     r"(?:subject to|terms of|conditions of) the {name}(?: (?:public )?licen[sc]e)?(?: version [0-9]+(?: [0-9])?)?"),
    ("under", 0.85, ("under",), r"under (?:the |a |an )?{name} (?:public )?licen[sc]e(?: version [0-9]+(?: [0-9])?)?"),
    ("named", 0.7, ("license", "licence"), r"{name} (?:public )?licen[sc]e(?: version [0-9]+(?: [0-9])?)?"),
    ("see", 0.6, ("license", "licence", "copying"), r"(?:licen[sc]e|copying) (?:is |see )?(?:the )?{name}"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    weight: float
    keyword: bytes
    one_of: frozenset
    pattern: re.Pattern


def build_rules(licenses=LICENSES, phrasings=PHRASINGS) -> list[Rule]:
    """All rules, highest priority first."""
    return [Rule(f"{phrasing}:{label}", label, weight, keyword.encode(), frozenset(w.encode() for w in words),
                 re.compile(rb"(?<![^ ])" + form.format(name=f"(?:{name})").encode() + rb"(?![^ ])"))
            for phrasing, weight, words, form in phrasings for label, keyword, name in licenses]


class Scanner:
    def __init__(self, rules: list[Rule] | None = None, base=BASE_PHRASES):
        self.rules = build_rules() if rules is None else rules
        self.base = base
        self.gate = frozenset().union(*(r.one_of for r in self.rules)) if self.rules else frozenset()
        self.base_gate = frozenset(p.split()[-2] for _, p in base)
        self.any_gate = self.gate | self.base_gate
        self.forms = {r.keyword: frozenset(keyword_forms(r.keyword)) for r in self.rules}

    def places(self, stream: bytes) -> list[tuple[str, int, int]]:
        """(label, first word, word after) of every place of a base phrase."""
        found = []
        padded = b" " + stream + b" "
        for label, phrase in self.base:
            needle, at, seen, word = b" " + phrase + b" ", 0, 0, 0
            n = phrase.count(b" ") + 1
            while (at := padded.find(needle, at)) >= 0:
                word += padded.count(b" ", seen, at)
                seen = at
                found.append((label, word, word + n))
                at += 1
        return found

    def detections(self, stream: bytes, words: frozenset) -> list[tuple[str, str, int, int, float]]:
        """(label, rule, first word, word after, weight), accepted in rule order."""
        if self.gate.isdisjoint(words):
            return []
        accepted: list[tuple[str, str, int, int, float]] = []
        inside = Cover()
        for r in self.rules:
            if r.one_of.isdisjoint(words) or self.forms[r.keyword].isdisjoint(words):
                continue
            seen = word = 0
            for m in r.pattern.finditer(stream):
                word += stream.count(b" ", seen, m.start())
                seen = m.start()
                end = word + stream.count(b" ", m.start(), m.end()) + 1
                if not inside.has(word, end):
                    inside.add(word, end)
                    accepted.append((r.label, r.name, word, end, r.weight))
        return accepted

    def scan(self, text: bytes) -> tuple[int, list, list]:
        words = text.translate(FOLD).split()
        if not words:
            return 0, [], []
        if self.any_gate.isdisjoint(words):
            return len(words), [], []
        stream = b" ".join(words)
        return len(words), self.places(stream), self.detections(stream, frozenset(words))


def keyword_forms(keyword: bytes) -> tuple[bytes, ...]:
    """Words that show a keyword in a text: spelled out or joined to a version number."""
    spelled = {b"cc": (b"creative",), b"nc": (b"noncommercial", b"commercial"), b"sa": (b"sharealike", b"alike", b"share"),
               b"nd": (b"noderivatives", b"derivatives", b"noderivs")}
    versions = tuple(keyword + v for v in (b"1", b"2", b"3", b"v", b"v1", b"v2", b"v3"))
    return (keyword, *spelled.get(keyword, ()), *versions)


class Cover:
    """Accepted intervals, sorted; asks whether a new one lies inside one of them."""

    def __init__(self):
        self.starts: list[int] = []
        self.furthest: list[int] = []  # greatest end up to here

    def has(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.furthest[i - 1] >= end

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.furthest.insert(i, max(end, self.furthest[i - 1] if i else end))
        while i + 1 < len(self.furthest) and self.furthest[i + 1] < end:
            self.furthest[i + 1] = end
            i += 1


PLACE = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
DETECTION = pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                       ("weight", pa.float64())])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, detections) for every row of ``docs``.

    ``places`` are the base phrases, ``detections`` what the rules accept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            got = [scanner.scan(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            places = [[{"label": x[0], "start": x[1], "end": x[2]} for x in g[1]] for g in got]
            found = [[dict(zip(("label", "rule", "start", "end", "weight"), x, strict=True)) for x in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(places, pa.list_(PLACE)),
                 pa.array(found, pa.list_(DETECTION))], names=["doc_id", "n_words", "places", "detections"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, places array<struct<label:string,start:bigint,end:bigint>>, "
             "detections array<struct<label:string,rule:string,start:bigint,end:bigint,weight:double>>")
