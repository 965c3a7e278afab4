"""Bitmaps of keys as small tables: rows that cannot meet a key are left out before they are shuffled.

Keys are longs whose low bits are spread evenly (hashes).  A row too many may pass, never one too few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WORD = 64               # bits of one bitmap row
MOST_BITS = 1 << 26     # the bitmap has a million rows at most


def bitmap(keys: DataFrame, n_keys: int, name: str = "h1") -> tuple[DataFrame, int]:
    """((word, marks), bits): a bitmap of the low bits of ``name``, about 16 bits a key up to ``MOST_BITS``.

    A row holds ``WORD`` bits, so there are bits / ``WORD`` rows at most and the stored table may be broadcast.
    """
    bits = WORD
    while bits < 16 * n_keys and bits < MOST_BITS:
        bits *= 2
    slot = F.pmod(name, F.lit(bits)).cast("long")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(WORD)).cast("int"))
    table = keys.groupBy(F.floor(slot / WORD).cast("int").alias("word")).agg(F.bit_or(mark).alias("marks"))
    return stored(table, "bitmap"), bits


def marked(rows: DataFrame, table: DataFrame, bits: int, name: str = "h1") -> DataFrame:
    """The rows whose ``name`` is marked in the bitmap: all keys, and few others."""
    slot = F.pmod(name, F.lit(bits)).cast("long")
    found = rows.withColumn("word", F.floor(slot / WORD).cast("int")).join(F.broadcast(table), "word")
    return found.filter(F.getbit("marks", F.pmod(slot, F.lit(WORD)).cast("int")) == 1).drop("word", "marks")
