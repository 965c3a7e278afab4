"""Seeded shuffle (T4), exact train/test split (T5), first rows.

The shuffled order is ``md5(id || '-' || seed)``: stable under any
partitioning, and the same in the SQL oracle.  The split puts the first
``ceil(share * n)`` rows of that order into training.

No global window or ``limit(k)`` with a data-sized ``k`` is used (both funnel
the data through one task).  Instead the k-th smallest key is found exactly by
radix refinement: a histogram of the next four hex digits of the key, over the
rows still in play, is aggregated (map-side combined, at most 65,536 rows back
to the driver), the bucket holding the k-th row is kept, and so on.  With md5
keys one or two passes reach a bucket of one row; each pass reads only the id
column.  Training rows are then a plain filter ``prefix(key) <= found prefix``.
Only where an id is repeated just at the cut do further passes go on with the md5
of the whole row, so sizes are exact then too; rows that are equal in every column stay together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGITS = 4          # hex digits per refinement pass (65,536 buckets)
_KEY_LEN = 32        # md5 hex length


def shuffle_key(id_col: Column, seed: int) -> Column:
    """T4: reproducible random order key."""
    return F.md5(F.concat_ws("-", id_col.cast("string"), F.lit(str(seed))))


def train_size(n: int, share: float) -> int:
    """``ceil(share * n)`` in exact decimal arithmetic (as SQL does)."""
    return math.ceil(Fraction(str(share)) * n)


def row_key(df: DataFrame) -> Column:
    """md5 of all columns of a row; equal for equal rows only."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def _starts(key: Column, row: Column, prefix: str) -> Column:
    """``key`` followed by ``row`` starts with ``prefix``."""
    if len(prefix) <= _KEY_LEN:
        return F.substring(key, 1, len(prefix)) == F.lit(prefix)
    return (key == F.lit(prefix[:_KEY_LEN])) & (F.substring(row, 1, len(prefix) - _KEY_LEN) == F.lit(prefix[_KEY_LEN:]))


def _up_to(key: Column, row: Column, prefix: str) -> Column:
    """``key`` followed by ``row`` is not above ``prefix`` in their first digits."""
    if len(prefix) <= _KEY_LEN:
        return F.substring(key, 1, len(prefix)) <= F.lit(prefix)
    tie = F.substring(row, 1, len(prefix) - _KEY_LEN) <= F.lit(prefix[_KEY_LEN:])
    return (key < F.lit(prefix[:_KEY_LEN])) | ((key == F.lit(prefix[:_KEY_LEN])) & tie)


def _kth_prefixes(keyed: DataFrame, share: float) -> dict:
    """Per group: the shortest key prefix that ends at the k-th smallest key.

    ``keyed`` has columns ``_g`` (group), ``_h`` (key) and ``_r`` (key of the whole row, which
    is read only once ``_h`` is used up).  Returns ``{group: prefix}``; ``""`` means no training rows.
    """
    length = 0
    open_groups: dict = {}       # group -> (prefix, k remaining)
    result: dict = {}
    first = True
    while first or open_groups:
        if first:
            rows = keyed
        else:
            cond = None
            for g, (prefix, _) in open_groups.items():
                c = (F.col("_g") == F.lit(g)) & _starts(F.col("_h"), F.col("_r"), prefix)
                cond = c if cond is None else (cond | c)
            rows = keyed.filter(cond)
        digits = F.substring("_h", length + 1, _DIGITS) if length < _KEY_LEN else F.substring("_r", length - _KEY_LEN + 1, _DIGITS)
        hist = (rows.groupBy("_g", digits.alias("_b"))
                .agg(F.count(F.lit(1)).alias("_n"))
                .collect())
        by_group: dict = {}
        for r in hist:
            by_group.setdefault(r["_g"], []).append((r["_b"], r["_n"]))
        if first:
            for g, buckets in by_group.items():
                k = train_size(sum(n for _, n in buckets), share)
                if k == 0:
                    result[g] = ""
                else:
                    open_groups[g] = ("", k)
            first = False
        next_open: dict = {}
        for g, (prefix, k) in open_groups.items():
            seen = 0
            for b, n in sorted(by_group.get(g, [])):
                if seen + n >= k:
                    new_prefix, k_left = prefix + b, k - seen
                    if n == k_left or length + _DIGITS >= 2 * _KEY_LEN:
                        result[g] = new_prefix
                    else:
                        next_open[g] = (new_prefix, k_left)
                    break
                seen += n
        open_groups = next_open
        length += _DIGITS
    return result


def with_train_flag(df: DataFrame, share: float = 0.8, seed: int = 1, id_col: str = "id",
                    group_col: str | None = None, groups: Sequence | None = None,
                    flag: str = "is_train") -> DataFrame:
    """T5: add ``flag`` = row is in the first ``ceil(share*n)`` of its group's
    shuffled order.  ``groups`` limits splitting to some group values (others
    are all test), e.g. only the *seen* repos.
    """
    if group_col is not None and groups is None:
        raise ValueError("name the groups: the driver keeps a histogram per group")
    key = shuffle_key(F.col(id_col), seed)
    g = F.col(group_col) if group_col else F.lit("all")
    row = row_key(df)
    keyed = df.select(g.alias("_g"), key.alias("_h"), row.alias("_r"))
    if groups is not None:
        keyed = keyed.filter(F.col("_g").isin(list(groups)))
    prefixes = _kth_prefixes(keyed, share)
    cond = F.lit(False)
    for gv, prefix in prefixes.items():
        if not prefix:
            continue
        cond = F.when((g == F.lit(gv)) & _up_to(key, row, prefix), F.lit(True)).otherwise(cond)
    return df.withColumn(flag, cond)


def first_rows(df: DataFrame, n: int = 50, seed: int = 1, id_col: str = "id") -> DataFrame:
    """The first ``n`` rows of the shuffled order (a top-n; n is small)."""
    return (df.withColumn("_h", shuffle_key(F.col(id_col), seed))
            .orderBy("_h").limit(n).drop("_h"))
