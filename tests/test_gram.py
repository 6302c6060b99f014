"""Grid search on sums of products: closed forms, optimality conditions, and the same choice as fitting one by one."""

import dataclasses

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shoplane.operators import gram
from shoplane.operators.models import REGISTRY, time_series_grid_search
from shoplane.operators.ordered import time_segments


def _data(n=400, d=7, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.geomspace(0.1, 30, d) + np.arange(d) * 100
    x[:, 3] = x[:, 2] * 2 - 5  # on one line
    x[:, d - 2] = (rng.random(n) < 0.1) * 3.0 if d > 4 else x[:, d - 2]
    return x, x @ rng.normal(size=d) + rng.normal(size=n) * 5 + 1000


def _frame(spark, x, y):
    rows = [(i, Vectors.dense(r) if i % 3 else Vectors.sparse(len(r), [(j, v) for j, v in enumerate(r) if v]), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "features", "label"]).repartition(5)


def test_moments_add_up(spark):
    x, y = _data()
    df = _frame(spark, x, y).withColumn("segment", (F.col("id") / 150).cast("int"))
    parts = gram.segment_moments(df)
    assert sorted(parts) == [0, 1, 2]
    total = parts[0] + parts[1] + parts[2]
    mean_x, mean_y, q, c, var = total.centred()
    np.testing.assert_allclose(mean_x, x.mean(axis=0))
    np.testing.assert_allclose(q, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(c, ((x - x.mean(axis=0)).T @ (y - y.mean())) / len(y), rtol=1e-9, atol=1e-9)
    assert total.n == 400 and mean_y == pytest.approx(y.mean()) and var == pytest.approx(y.var())
    assert gram.segment_moments(df.limit(0)) == {}


@pytest.mark.parametrize("l1,l2", [(0.0, 0.0), (0.0, 0.3), (0.5, 0.0), (0.2, 0.7), (5.0, 0.1), (1e6, 0.0)])
def test_solutions_meet_the_optimality_conditions(spark, l1, l2):
    x, y = _data(seed=3)
    m = gram.segment_moments(_frame(spark, x, y).withColumn("segment", F.lit(0)))[0]
    w, b = gram.solve(m, l1, l2)
    error = y - x @ w - b
    slope = x.T @ error / len(y) - l2 * w  # of the smooth part
    assert abs(error.mean()) < 1e-7
    tol = 1e-5 * np.abs(x - x.mean(axis=0)).max()
    used = w != 0
    np.testing.assert_allclose(slope[used], l1 * np.sign(w[used]), atol=tol)
    assert (np.abs(slope[~used]) <= l1 + tol).all()
    if l1 == 1e6:
        assert not used.any() and b == pytest.approx(y.mean())


@pytest.mark.parametrize("name", ["Linear Regression", "Ridge Regression", "Lasso Regression", "Elastic Net"])
@pytest.mark.parametrize("fitted", [False, True])
def test_same_errors_as_single_fits(spark, name, fitted):
    x, y = _data(300, 4, 5)
    x[:, 3] += np.random.default_rng(1).normal(size=300)  # not collinear: one solution
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, label double")
    df, n = time_segments(df, ["id"], 5)
    first = [VectorAssembler(inputCols=list("abcd"), outputCol="raw" if fitted else "features")]
    if fitted:
        first.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    spec = REGISTRY[name]
    spec = dataclasses.replace(spec, grid=spec.grid[:2])
    stages = lambda est: Pipeline(stages=[*first, est])
    got = time_series_grid_search(df, n, stages, spec, segment_col="segment")
    want = time_series_grid_search(df, n, stages, dataclasses.replace(spec, penalty=None), segment_col="segment")
    assert got[1] == want[1]
    for a, b in zip(got[3], want[3]):
        assert a["cv_mae"] == pytest.approx(b["cv_mae"], rel=2e-3)
