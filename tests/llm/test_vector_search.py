"""Exact vector search against all pairs in whole numbers and the SQL twin."""

import math
import random

import duckdb
import numpy as np
import pytest

from shoplane.llm import vector_search
from shoplane.llm.queries import QUERIES, SQL
from shoplane.llm.vector_search import top_k
from tests.conftest import SF_SMALL


def brute(rows, k):
    good, queries = [], {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(256 * x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
            if i is not None and i % 50 == 0:
                queries.setdefault(i, {})[tuple(v)] = good[-1][1]
    queries = {i: list(vectors.values()) for i, vectors in queries.items()}
    out = []
    for i, vectors in queries.items():
        scored = []
        for q in vectors:
            for j, c in good:
                if j != i and len(c) == len(q):
                    s = max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, c))))
                    scored.append((-s, j is None, j or 0, j))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark):
    got = QUERIES["op13_vector_search"](spark, SF_SMALL)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = found(got)
    assert got == brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()], 5)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
    assert got == sorted(db.execute(SQL["op13_vector_search"]).fetchall())


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    near = [rng.uniform(-1, 1) for _ in range(10)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(10)]) for i in range(400)]
    rows += [(1000 + i, near) for i in range(30)] + [(50, near), (50, near), (100, near), (-50, near), (7, near), (7, near)]  # ties and repeats
    rows += [(None, near), (3000, None), (3050, []), (3051, []), (3100, [1.0, None]), (3150, [math.nan] * 10), (3200, [math.inf] * 10),
             (3250, [0.5, -0.5]), (3251, [2.0, -2.0]), (3300, [1e300, -1e300]), (3301, [1e12, 3.0]), (3350, [1e307] * 3), (3400, [-0.0] * 10)]
    schema = "vec_id bigint, embedding array<double>, rank int, query_id int, ids string"
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)
    want = brute(rows, 5)
    assert found(top_k(df, "vec_id % 50 = 0", k=5)) == want
    assert found(top_k(df.repartition(7), "vec_id % 50 = 0", k=5, dim_block=3, chunk=16, block_queries=4)) == want
    monkeypatch.setattr(vector_search, "_COMPACT", 2.0)  # compacted from the start
    search = vector_search._Search([0], np.ones((1, 10)), 2, 4)
    search.scan([1, 2, 3], np.array([[1, 5, 3]] * 10))
    assert search.best() == [(0, 2, 50), (0, 3, 30)]
    assert found(top_k(df, "vec_id % 50 = 0", k=500, chunk=64)) == brute(rows, 500)
    assert top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bounds_drop_no_winner(seed):
    """Skewed masses, so that most candidates go early, against the plain product."""
    rng = np.random.default_rng(seed)
    c = np.floor(256 * rng.normal(size=(3000, 32)) * np.geomspace(1, 0.01, 32))
    c[rng.integers(0, 3000, 40)] = c[5]
    ids = list(range(3000))
    search = vector_search._Search(ids[:130], c[:130], 5, 8)
    for lo in range(0, 3000, 700):
        search.scan(ids[lo:lo + 700], c[lo:lo + 700].T)
    scores = c[:130] @ c.T
    want = []
    for i in range(130):
        scores[i, i] = -np.inf
        want += [(i, int(j), int(scores[i, j])) for j in np.lexsort((ids, -scores[i]))[:5]]
    assert search.best() == want
