"""Joins and unions.

``merge_on`` is a plain equi-join: Catalyst/AQE choose broadcast-hash when a
side is small by statistics, else sort-merge on the key, and AQE's skew-join
handling splits a hot key's partition (a key holding a third of all rows is
spread over several tasks; the other side's rows for it are replicated).
Nothing here forces a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplane.operators.schema import q


def merge_on(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
             how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"),
             drop: tuple[str, ...] = ("ID_y",), null_safe: bool = False) -> DataFrame:
    """Equi-join on differently (or equally) named keys with dataframe-
    merge naming: columns present on both sides get ``suffixes``; with equal
    key names one key column is kept. Duplicate keys multiply. Columns listed
    in ``drop`` are removed when present.

    ``null_safe=True`` also matches null keys to each other.
    """
    same_key = left_on == right_on
    overlap = (set(left.columns) & set(right.columns)) - ({left_on} if same_key else set())
    lname = {c: (c + suffixes[0] if c in overlap else c) for c in left.columns}
    rname = {c: (c + suffixes[1] if c in overlap else c) for c in right.columns}
    rkey_tmp = "__rkey__" if same_key else rname[right_on]
    L = left.select(*[F.col(q(c)).alias(lname[c]) for c in left.columns])
    R = right.select(*[F.col(q(c)).alias(rkey_tmp if (same_key and c == right_on) else rname[c])
                       for c in right.columns])
    lk, rk = L[q(lname[left_on])], R[q(rkey_tmp)]
    cond = lk.eqNullSafe(rk) if null_safe else lk == rk
    joined = L.join(R, cond, how)
    cols = [F.col(q(lname[c])) for c in left.columns]
    for c in right.columns:
        if same_key and c == right_on:
            if how in ("right", "outer", "full", "fullouter", "full_outer"):
                cols[left.columns.index(left_on)] = F.coalesce(
                    F.col(q(lname[left_on])), F.col(q(rkey_tmp))).alias(lname[left_on])
            continue
        cols.append(F.col(q(rname[c])))
    out = joined.select(*cols)
    present = [c for c in drop if c in out.columns]
    return out.drop(*present) if present else out


def union_by_name(frames: list[DataFrame], allow_missing: bool = True) -> DataFrame:
    """Concatenate by column name (missing columns -> null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
