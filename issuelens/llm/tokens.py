"""Token counts by byte-pair merging, and token ids, for a vocabulary file of the ``tokenizers`` library.

``count_tokens`` does its own merging: a piece starts as one symbol per byte (the last
one carries the word end); the adjacent pair of lowest rank is popped from a heap, its
symbols are joined in a linked list, and the new neighbour pairs are pushed.  The
count is the initial symbols minus the merges; no ids are made.  Normalising and
splitting into pieces is the vocabulary's own (``tokenizers`` normalizer and
pre-tokenizer), applied to white-space separated chunks: the splitting rule never
crosses white space.  Chunks repeat, so each task keeps a bounded table of counts.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special token strings
inside a text count one each, as the library does by default; equal rows get equal
counts; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "word_bpe_49k.json"
# Entries a task keeps in its table of chunks (about 200 bytes each).
TABLE_ENTRIES = 1_300_000
# White space of the splitting rule; Python's own also has \x1c-\x1f.
BLANKS = re.compile(r"[^\S\x1c-\x1f]+")
# Lower-casing U+0130 leaves a mark, which joins the sign behind it in one piece.
NOT_PLAIN = re.compile(r"[^\w\s]{2}|[_'<\u0130\u0250-\U0010ffff]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def chunks_of(text: str) -> list[str]:
    """The text without its white space, cut so that chunks can be tokenised one by one.

    In a plain Latin text, where no two symbols touch, commas and full stops are pieces of
    their own and case does not matter, so they are cut off and fewer chunks differ.
    """
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in BLANKS.split(text) if c]
    if NOT_PLAIN.search(text) is None:
        text = text.lower().replace(",", " , ").replace(".", " . ")
    return text.split()


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges of ``ranks``."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    sym = list(symbols)
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:  # one of the two was merged meanwhile
            continue
        sym[i], sym[j] = a + b, ""
        merges += 1
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := ranks.get((sym[i], sym[k]))) is not None:
                heappush(heap, (r, i, sym[i], sym[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
            heappush(heap, (r, h, sym[h], sym[i]))
    return n - merges


class Table(dict):
    """Chunk -> value; a chunk that is not there is asked of ``make``."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk):
        return self.make(chunk)


class Counter:
    """Counts of chunks, by heap and linked list, remembered up to ``TABLE_ENTRIES``."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {m: i for i, m in enumerate(pairs)}
        self.vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.normalize, self.split = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.table = Table(self.chunk)
        self.pieces: dict[str, int] = {}
        self.entries = entries

    def piece(self, p: str) -> int:
        """``p``: a piece in the vocabulary's byte letters."""
        n = self.pieces.get(p)
        if n is None:
            symbols = list(p)
            symbols[-1] += self.end
            n = merge_count([s for s in symbols if s in self.vocab], self.ranks)  # letters unknown to it make no token
            if len(p) <= 64:
                if len(self.pieces) >= self.entries:
                    self.pieces.clear()
                self.pieces[p] = n
        return n

    def chunk(self, c: str) -> int:
        total, parts = 0, [c]
        if self.special and "<" in c:
            parts = self.special.split(c)
            total = len(parts) - 1
        for part in parts:
            if part:
                total += sum(self.piece(p) for p, _ in self.split(self.normalize(part)))
        if len(c) <= 64:  # longer chunks hardly repeat
            self.table[c] = total
        return total

    def text(self, text: str) -> int:
        if len(self.table) >= self.entries:
            self.table.clear()
        return sum(map(self.table.__getitem__, chunks_of(text)))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of this worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).text
        for b in batches:
            texts = b.column(1).to_pylist()
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            n = [count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


class Encoder:
    """Token ids of whole texts by the ``tokenizers`` library, as little-endian uint32 bytes.

    Words not yet in the table are encoded together and told apart by their word ends.
    """

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            end = json.load(f)["model"].get("end_of_word_suffix")
        self.ends = frozenset(i for t, i in self.tok.get_vocab().items() if t.endswith(end)) if end else None
        self.table = Table(self.later)
        self.unknown: list[str] = []
        self.entries = entries

    def later(self, chunk: str) -> bytes:
        self.unknown.append(chunk)
        return b""

    def learn(self, chunks: list[str]) -> None:
        words = [c for c in chunks if c.isalpha()]
        if self.ends is not None and words:
            # A word is one piece, and only a piece's last id carries the word end.
            ids = array("I", self.encode(" ".join(words)))
            ends = [i + 1 for i, x in enumerate(ids) if x in self.ends]
            if len(ends) == len(words):
                data = ids.tobytes()
                self.table.update((c, data[4 * i:4 * j]) for c, i, j in zip(words, [0, *ends], ends, strict=False))
        for c in chunks:
            if c not in self.table:
                self.table[c] = array("I", self.encode(c)).tobytes()

    def encode(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def text(self, text: str) -> bytes:
        table = self.table
        if len(table) >= self.entries:
            table.clear()
        chunks = chunks_of(text)
        out = b"".join(map(table.__getitem__, chunks))
        if self.unknown:
            new = list(dict.fromkeys(self.unknown))
            self.learn(new)
            out = b"".join(map(table.__getitem__, chunks))
            self.unknown.clear()
            for c in new:
                if len(c) > 64:  # longer chunks hardly repeat
                    del table[c]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
