"""Bucket search: cut points against bisect; wide nullable keys against one sort."""

import bisect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoplane.operators.features import FeatureEngineer
from shoplane.operators.ordered import _Cuts, ordered_features, ordered_index


def test_assign_matches_bisect():
    rng = np.random.default_rng(0)
    draw = lambda n: list(zip(rng.integers(0, 2, n).tolist(), (rng.integers(0, 40, n) + 2**60).tolist(),
                              rng.choice(["a", "b", "é", "\U0001F600"], n).tolist(), rng.integers(0, 9, n).astype(float).tolist()))
    cuts = sorted(set(draw(400)))
    spec = _Cuts(cuts, ["int", "int", "str", "float"]).prepare()
    rows = draw(3000) + cuts
    got = spec.assign([pd.Series(c) for c in zip(*rows)])
    assert got.tolist() == [bisect.bisect_right(cuts, r) for r in rows]


def test_a_million_cuts_a_dimension_is_still_one_vector_search():
    n = 1 << 20
    cuts = [(0, 2**60 + 3 * i, 7 * i) for i in range(n)]
    spec = _Cuts(cuts, ["int", "int", "int"]).prepare()
    i = np.arange(0, n, 13)
    got = spec.assign([pd.Series(np.zeros(len(i), np.int64)), pd.Series(2**60 + 3 * i), pd.Series(7 * i - 1)])
    assert (got == i).all()


def test_wide_nullable_keys(spark):
    rows = [(i, None if i % 5 == 0 else 2**60 + (i * 7919) % 4001) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, k bigint").repartition(7, F.col("id") % 5)
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])))}
    got = {r.id: r.row_idx for r in ordered_index(df, ["k", "id"], rows_per_bucket=100).collect()}
    assert got == want


@pytest.mark.parametrize("rows_per_bucket", [5, 37, 10_000])
@pytest.mark.parametrize("nulls", [0.1, 0.9])
def test_every_column_filled_after_the_lags(spark, rows_per_bucket, nulls):
    """E7 against pandas: shift, rolling mean, then bfill and ffill of the whole frame, over any number of buckets."""
    rng = np.random.default_rng(rows_per_bucket)
    n = 200
    gone = lambda p: rng.random(n) < p
    pdf = pd.DataFrame({"row_id": np.arange(n), "Date In": pd.to_datetime("2021-01-01") + pd.to_timedelta(rng.integers(0, 60, n), "D")})
    pdf = pdf.sort_values(["Date In", "row_id"]).reset_index(drop=True)
    v = pd.Series(rng.normal(size=n).round(3)).mask(gone(nulls))
    v[:4], v[150:] = np.nan, np.nan
    pdf["v"] = v
    pdf["s"] = pd.Series([f"t{i}" for i in range(n)], dtype=object).mask(gone(nulls))
    pdf["i"] = pd.Series(np.arange(n, dtype=float)).mask(gone(0.97))
    pdf["none"] = np.nan
    want = pdf.assign(lag_1=v.shift(1), lag_2=v.shift(2), rolling_mean_3=v.rolling(3).mean()).bfill().ffill().sort_values("row_id").reset_index(drop=True)
    rows = [tuple(None if x is None or x != x else x.to_pydatetime() if hasattr(x, "to_pydatetime") else x for x in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "row_id int, `Date In` timestamp_ntz, v double, s string, i double, none double").repartition(5)
    fe = FeatureEngineer(dateCol="Date In", valueCol="v", orderCols=["Date In", "row_id"], withLags=True, rowsPerBucket=rows_per_bucket)
    out = fe.transform(df)
    got = out.orderBy("row_id").toPandas()
    assert got.shape[0] == n
    for c in ("v", "s", "i", "none", "lag_1", "lag_2", "rolling_mean_3"):
        a, b = got[c], want[c]
        assert all((x is None or x != x) and (y is None or y != y) or x == y or abs(x - y) < 1e-9 for x, y in zip(a, b)), c
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 and plan.count("Exchange hashpartitioning") <= 2  # named once in the tree and once in its final form


def test_derived_fills_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), None if i % 7 == 0 else f"g{i % 3}", None if rng.random() < 0.5 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, g string, v double").repartition(4)
    out = ordered_features(df, ["k"], ["g"], index_col="i", lag_col="v", lags=(1, 3), rolling=2, fill_cols=["v"], fill_derived=True, rows_per_bucket=11)
    got = {r.k: (r.i, r.v, r.lag_1, r.lag_3, r.rolling_mean_2) for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["k", "g", "v"])
    pdf["v"] = pdf["v"].astype(float)
    for _, part in pdf.groupby(pdf["g"].fillna("?")):
        w = part.assign(l1=part.v.shift(1), l3=part.v.shift(3), r=part.v.rolling(2).mean())[["v", "l1", "l3", "r"]].bfill().ffill()
        for i, (k, row) in enumerate(zip(part.k, w.itertuples(index=False))):
            assert got[k][0] == i and got[k][1:] == tuple(None if x != x else x for x in row)
