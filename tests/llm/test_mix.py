"""Poisson replication: the distribution, the mix and awkward rows."""

import collections
import hashlib
import math

from pyspark.sql import functions as F

from shoplane.llm import mix
from shoplane.llm.mix import mix_sources, source_rates
from tests.llm.conftest import AWKWARD


def test_rates_reach_target_shares(spark):
    rows = [(i, "x" * (1 + i % 7), "big" if i % 3 else f"s{i % 2}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    rates = {r.source: r.rate for r in source_rates(docs, {"big": 1, "s0": 1, "s1": 2}, "source", "text", None).collect()}
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t)
    total = sum(size.values())
    assert all(math.isclose(rates[s] * size[s], total * w / 4) for s, w in (("big", 1), ("s0", 1), ("s1", 2)))
    got = collections.Counter()
    for r in mix_sources(docs, {"big": 1, "s0": 1, "s1": 2}).collect():
        got[r.source] += len(r.text)
    assert all(abs(got[s] / total - w / 4) < 0.02 for s, w in (("big", 1), ("s0", 1), ("s1", 2)))


def test_counts_are_poisson_at_small_and_large_rates(spark):
    for rate in (0.3, 2.0, 30.0):
        docs = spark.createDataFrame([(i, "x", "a") for i in range(4000)], "doc_id bigint, text string, source string")
        copies = collections.Counter(r.doc_id for r in mix_sources(docs, {"a": 1}, target_chars=int(4000 * rate)).select("doc_id").collect())
        values = [copies.get(i, 0) for i in range(4000)]
        mean = sum(values) / 4000
        var = sum((v - mean) ** 2 for v in values) / 4000
        assert abs(mean - rate) < 5 * math.sqrt(rate / 4000) and abs(var / rate - 1) < 0.15
        if rate < 1:
            assert abs(values.count(0) / 4000 - math.exp(-rate)) < 0.04


def test_awkward_rows(spark, awkward, none):
    got = mix_sources(awkward, seed=1)
    rows = got.collect()
    assert got.columns == [*awkward.columns, "copy_no", "shuffle_key"]
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys) and rows
    by = collections.Counter((r.doc_id, r.text) for r in rows)
    given = collections.Counter(r[:2] for r in AWKWARD)
    assert set(by) <= set(given)
    assert by[(7, "same row")] % 2 == 0  # equal ids draw alike
    assert [tuple(r) for r in mix_sources(awkward, seed=1).collect()] == [tuple(r) for r in rows]
    assert mix_sources(none).count() == 0
    assert mix_sources(awkward, {"a": 1.0}).where("source <> 'a'").count() == 0


def brute_copies(key, rate, seed=42):
    """Sum of inversions at the hashed uniforms."""
    parts = max(math.ceil(rate / 8), 1)
    cdf = [math.exp(-rate / parts)]
    p = cdf[0]
    for k in range(1, 80):
        p = p * (rate / parts) / k
        cdf.append(cdf[-1] + p)
    return sum(sum(c <= int(hashlib.md5(f"{seed}:{j}:{key}".encode()).hexdigest()[:13], 16) / 2**52 for c in cdf) for j in range(1, parts + 1))


def test_copies_of_a_tiny_source_come_from_several_tasks(spark):
    rows = [(i, "x" * 20_000, "big", "k") for i in range(3)] + [(5, "y", "tiny", "k"), (None, "z", None, "k"), (6, "w", "tiny", "k"), (6, "v", "tiny", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, span_s string")
    rates = {r.source: r.rate for r in source_rates(docs, None, "source", "text", None).collect()}
    assert rates[None] / 8 > mix.CHUNK and rates["big"] < 1
    got = mix_sources(docs)
    assert got.columns == [*docs.columns, "copy_no", "shuffle_key"]
    by = collections.defaultdict(list)
    for r in got.select("doc_id", "text", "source", "copy_no").collect():
        by[r.doc_id, r.text, r.source].append(r.copy_no)
    for i, t, s, _ in rows:
        n = brute_copies("" if i is None else i, rates[s])
        assert sorted(by[i, t, s]) == list(range(1, n + 1)), (i, s)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    at = (mix._replicated(docs, source_rates(docs, None, "source", "text", None), key, 42, "source", "copy_no")
          .where("doc_id is null").groupBy(F.spark_partition_id()).count().collect())
    assert len(at) > 1


def test_rows_without_an_id_draw_by_their_text(spark):
    rows = [(None, f"text {i:04}", "large") for i in range(2000)] + [(1, "small", "small")] + [(9, f"more {i:04}", "large") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix_sources(docs, {"large": 1, "small": 9}, target_chars=20 * 4000, by_text=True).where("source = 'large'")
    n = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert all(abs(n[i] / 2000 - 0.22) < 0.06 for i in (None, 9)), n
