"""The most frequent terms of a column of token arrays, exactly (M1).

A first pass adds up occurrences by hash bucket: a table of bounded size,
whatever the vocabulary, in which a term's bucket is an upper bound on the term. A
second pass counts the terms of the largest buckets only. Once the last of the wanted terms has
more occurrences than the largest bucket left out, no other term can be among them;
until then more buckets are counted. Ties are resolved by the term, so a bucket as large as the last term counts as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the first pass.
BUCKETS = 1 << 20


def top_terms(df: DataFrame, tokens: Column, k: int, buckets: int = BUCKETS, first: int | None = None) -> list[tuple[str, int]]:
    """(term, occurrences) of the ``k`` most frequent terms, ties in ascending order of the term."""
    words = df.select(F.explode(tokens).alias("w"))
    bucket = F.pmod(F.xxhash64("w"), F.lit(buckets))
    sizes = words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    take = first or 4 * k
    while True:
        largest = sizes.orderBy(F.desc("n"), "b").limit(take + 1).collect()
        rest = largest[take]["n"] if len(largest) > take else 0  # no term outside the counted buckets has more
        counted = df.sparkSession.createDataFrame([(r["b"],) for r in largest[:take]], "b long")
        # at most 2**20 rows of 8 bytes
        terms = words.withColumn("b", bucket).join(F.broadcast(counted), "b", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        top = [(r["w"], r["n"]) for r in terms.orderBy(F.desc("n"), "w").limit(k).collect()]
        if not rest or len(top) == k and top[-1][1] > rest:
            return top
        take *= 4


def document_counts(df: DataFrame, tokens: Column, terms: list[str]) -> tuple[int, dict[str, int]]:
    """(rows, rows that hold each of ``terms``) in one aggregate; a row without tokens counts as a row."""
    hit = F.array_distinct(F.filter(tokens, lambda w: w.isin(terms))) if terms else F.array().cast("array<string>")
    rows = df.select(F.explode(F.concat(F.coalesce(hit, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("w"))
    counts = {r["w"]: r["n"] for r in rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop(None, 0), counts


def _by_fold(segment: str, folds: list[int]) -> list[Column]:
    """How many rows of a group stand in a segment below each fold."""
    return [F.count(F.when(F.col(segment) < f, 1)).alias(f"n{i}") for i, f in enumerate(folds)]


def _largest(counts: DataFrame, key: str, wanted: dict[int, int]) -> dict[int, list[tuple]]:
    """By fold, its ``wanted`` largest (key, count) of a table with a count a fold, ties in ascending order of the key; in one job."""
    tops = [counts.where(F.col(f"n{i}") > 0).select(F.lit(i).alias("i"), F.col(key).alias("k"), F.col(f"n{i}").alias("n")).orderBy(F.desc("n"), "k").limit(k)
            for i, k in wanted.items()]
    out: dict[int, list[tuple]] = {i: [] for i in wanted}
    for r in reduce(DataFrame.union, tops).collect():
        out[r["i"]].append((r["k"], r["n"]))
    return {i: sorted(v, key=lambda kn: (-kn[1], kn[0])) for i, v in out.items()}


def fold_top_terms(df: DataFrame, tokens: Column, segment: str, folds: list[int], k: int, buckets: int = BUCKETS,
                   first: int | None = None) -> list[list[tuple[str, int]]]:
    """``top_terms`` of the rows in a ``segment`` below each of ``folds``: all folds are counted in the same passes."""
    words = df.select(F.col(segment).alias("s"), F.explode(tokens).alias("w"))
    bucket = F.pmod(F.xxhash64("w"), F.lit(buckets))
    sizes = words.groupBy(bucket.alias("b")).agg(*_by_fold("s", folds)).checkpoint(eager=True)
    take, found = first or 4 * k, {}
    while len(found) < len(folds):
        left = [i for i in range(len(folds)) if i not in found]
        largest = _largest(sizes, "b", dict.fromkeys(left, take + 1))
        counted = df.sparkSession.createDataFrame([(b,) for b in sorted({b for v in largest.values() for b, _ in v[:take]})], "b long")
        # at most 2**20 rows of 8 bytes
        terms = words.withColumn("b", bucket).join(F.broadcast(counted), "b", "left_semi").groupBy("w").agg(*_by_fold("s", folds)).checkpoint(eager=True)
        for i, top in _largest(terms, "w", dict.fromkeys(left, k)).items():
            rest = largest[i][take][1] if len(largest[i]) > take else 0
            if not rest or len(top) == k and top[-1][1] > rest:
                found[i] = top
        take *= 4
    return [found[i] for i in range(len(folds))]


def fold_document_counts(df: DataFrame, tokens: Column, segment: str, folds: list[int], terms: list[str]) -> list[tuple[int, dict[str, int]]]:
    """``document_counts`` of the rows in a ``segment`` below each of ``folds``, in one aggregate."""
    none = F.array().cast("array<string>")
    hit = F.array_distinct(F.filter(tokens, lambda w: w.isin(terms))) if terms else none
    rows = df.select(F.col(segment).alias("s"), F.explode(F.concat(F.coalesce(hit, none), F.array(F.lit(None).cast("string")))).alias("w"))
    counts = {r["w"]: r for r in rows.groupBy("w").agg(*_by_fold("s", folds)).collect()}
    every = counts.pop(None, None)
    return [(every[f"n{i}"] if every else 0, {w: counts[w][f"n{i}"] if w in counts else 0 for w in terms}) for i in range(len(folds))]
