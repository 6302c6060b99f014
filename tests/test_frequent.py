"""Most frequent terms: exact whatever the buckets, ties at the last rank included."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoplane.operators.features import TfidfTop
from shoplane.operators.frequent import document_counts, top_terms


@pytest.mark.parametrize("buckets,first", [(1 << 20, None), (7, 1), (64, 2), (1000, 1)])
def test_top_terms(spark, buckets, first):
    rng = random.Random(buckets)
    docs = [[rng.choice(["hot", f"w{int(rng.paretovariate(0.6)) % 500}", f"u{rng.randrange(10**6)}"]) for _ in range(rng.randrange(40))] for _ in range(300)]
    docs += [[f"tie{i:03d}"] * 9 for i in range(150)] + [None, []]
    df = spark.createDataFrame([(d,) for d in docs], "t array<string>").repartition(5)
    counts = Counter(w for d in docs for w in d or [])
    for k in (1, 5, 60, 100, 10**5):
        assert top_terms(df, F.col("t"), k, buckets, first) == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    n, held = document_counts(df, F.col("t"), ["hot", "w1", "tie000", "nowhere"])
    assert n == len(docs) and held == {w: sum(w in (d or []) for d in docs) for w in ("hot", "w1", "tie000")}


def test_ties_at_the_last_rank(spark):
    """200 terms of equal count behind 60 more frequent ones: the first 40 of them by name complete the vocabulary."""
    docs = [" ".join([f"top{i:02d}"] * 3) for i in range(60)] + [f"tie{i:03d} tie{i:03d}" for i in reversed(range(200))]
    df = spark.createDataFrame([(d,) for d in docs], "t string").repartition(3)
    model = TfidfTop(inputCol="t", outputCol="v", maxFeatures=100).fit(df)
    assert model.getOrDefault("vocabulary") == [f"tie{i:03d}" for i in range(40)] + [f"top{i:02d}" for i in range(60)]
    empty = TfidfTop(inputCol="t", outputCol="v").fit(df.limit(0))
    assert empty.getOrDefault("vocabulary") == []
