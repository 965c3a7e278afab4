"""Pack tokenised documents into sequences by first-fit decreasing.

One pass over the texts makes the ids of each document, ends them with a separator id and
cuts them into pieces: whole sequences first, then the rest.  Only (document, start,
length, crc) leaves that pass, never ids or texts.  Pieces are dealt by a digest into
randomised groups of about ``group_pieces``; each group is packed on its own, largest
piece first, into the first bin with room, which a tournament tree over the bins' free
capacities finds in logarithmic time.  The number of groups follows the number of
pieces, so a task holds a bounded number whatever the input, and a copy of a document
is dealt by its own position, so no key gathers in one group.

Defined results: a null or empty text is the separator alone; equal rows are packed
separately; an empty table gives an empty result; extra columns are not looked at;
null ids stay null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder, vocabulary_path

SEQUENCE = 4096
SEPARATOR = 2
GROUP_PIECES = 4000


class Tournament:
    """Free capacities of bins; every inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with room for ``size``; takes the room."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.best[node] < size:
                node += 1
        found, room = node - self.leaves, self.best[node]
        self.best[node] = room - size
        node //= 2
        while node:
            self.best[node] = max(self.best[2 * node], self.best[2 * node + 1])
            node //= 2
        return found, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of every item; ties in size keep their order."""
    where, offset = [0] * len(sizes), [0] * len(sizes)
    tree = Tournament(max(1, len(sizes)), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        where[i], room = tree.first_fit(sizes[i])
        offset[i] = capacity - room
    return where, offset


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def pieces(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, separator: int = SEPARATOR,
           seed: int = 11) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, deal) per piece; no shuffle."""
    path = path or vocabulary_path()
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encode, n = encoder(path).text, 0
        part = TaskContext.get().partitionId()
        for b in batches:
            row, start, size, crc, total, deal = [], [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                data = (encode(t) if t else b"") + end
                view, tokens = memoryview(data), len(data) // 4
                for s in range(0, tokens, length):
                    cut = view[4 * s: 4 * (s + length)]
                    row.append(i)
                    start.append(s)
                    size.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    total.append(tokens)
                    n += 1
                    deal.append(_mix(_mix(seed) ^ _mix((part << 40) + n)) >> 1)
            ints = [pa.array(x, pa.int64()) for x in (start, size, crc, total, deal)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *ints],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, deal bigint")


def pack(pieces_: DataFrame, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to stored pieces."""
    groups = max(1, -(-pieces_.count() // group_pieces))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["deal", "start", "length"], kind="stable").reset_index(drop=True)
        where, offset = first_fit_decreasing(g["length"].tolist(), capacity)
        g["sequence_id"] = (g["deal"] % groups) * (1 << 24) + np.array(where, dtype=np.int64)
        g["offset"] = np.array(offset, dtype=np.int64)
        return g.drop(columns="deal")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces_.schema if f.name != "deal")
    return pieces_.groupBy((F.col("deal") % groups).alias("_group")).applyInPandas(
        run, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = SEQUENCE,
                   separator: int = SEPARATOR, seed: int = 11) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    cut = stored(pieces(docs, path, length, separator, seed), "pieces")
    return pack(cut, length).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
