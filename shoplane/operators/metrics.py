"""Aggregates: regression metrics, exact median, residual summaries.

Every metric is a partial/final hash aggregate (map-side combine, one small
shuffle of per-group partial states). The exact median is found by radix
selection (``selection``), which never buffers or sorts a group.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplane.operators.schema import col
from shoplane.operators.selection import exact_median


def _grp(by):
    return [col(b) for b in (by or [])]


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """A1: one row per named frame with its row count (lazy, one plan)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def mean_std(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A2: mean and population standard deviation."""
    x = col(value)
    agg = [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std_pop"), F.count(x).alias("n")]
    return df.groupBy(*_grp(by)).agg(*agg) if by else df.agg(*agg)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """A3: distinct categories of a column (partial dedupe before the shuffle)."""
    return df.select(col(column)).distinct()


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None,
                       with_median: bool = True) -> DataFrame:
    """A4-A10 in one aggregate pass (plus the exact median, joined on ``by``):
    ``n, mae, median_ae, mse, rmse, r2, explained_variance, mape``.

    R2 and explained variance follow the finite convention for a constant
    target: 1.0 when the errors are all zero, else 0.0. Rows with a null or NaN
    label or prediction count nowhere. MAPE (percent) is over
    rows with a non-zero target and null when there are none.
    """
    Y, P = col(y).cast("double"), col(p).cast("double")
    df = df.where(Y.isNotNull() & P.isNotNull() & ~F.isnan(Y) & ~F.isnan(P))  # valid pairs only
    e = Y - P
    agg = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(Y).alias("_vy"),
        F.var_pop(e).alias("_ve"),
        (F.avg(F.when(Y != 0, F.abs(e / Y))) * 100).alias("mape"),
    ]
    g = _grp(by)
    base = df.groupBy(*g).agg(*agg) if by else df.agg(*agg)
    sst = F.col("_vy") * F.col("n")
    r2 = (F.when(sst == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("_sse") / sst))
    ev = (F.when(F.col("_vy") == 0, F.when(F.col("_ve") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("_ve") / F.col("_vy")))
    out = base.select(*[col(b) for b in (by or [])], "n", "mae", "mse",
                      F.sqrt("mse").alias("rmse"), r2.alias("r2"),
                      ev.alias("explained_variance"), "mape")
    if with_median:
        med = exact_median(df.select(*g, F.abs(e).alias("_ae")), "_ae", by, out="median_ae")
        if by:
            med = med.select("median_ae", *[col(b).alias(f"_m{i}") for i, b in enumerate(by)])
            same = [col(b).eqNullSafe(F.col(f"_m{i}")) for i, b in enumerate(by)]  # a null group has a median too
            out = out.join(med, same, "left").drop(*[f"_m{i}" for i in range(len(by))])
        else:
            out = out.withColumn("median_ae", F.lit(med.first()["median_ae"]).cast("double"))
    return out


def residual_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max] (max falls in the last bin;
    a constant column uses [v-0.5, v+0.5]). All ``bins`` rows are returned."""
    x = col(value).cast("double")
    src = df.select(x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    mm = src.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    lo0, hi0 = mm.select("lo").scalar(), mm.select("hi").scalar()
    lo = F.when(lo0 == hi0, lo0 - 0.5).otherwise(lo0)
    hi = F.when(lo0 == hi0, hi0 + 0.5).otherwise(hi0)
    b = F.least(F.floor((F.col("_x") - lo) * (F.lit(float(bins)) / (hi - lo))).cast("long"),
                F.lit(bins - 1))
    counts = src.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    grid = spark.range(bins).withColumnRenamed("id", "bin")
    width = (hi - lo) / bins
    return (grid.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


#: Terms of a cell's Hermite expansion: with cells one bandwidth wide the rest is below 1e-15 of a row's kernel.
_HERMITE_TERMS = 20
#: Bandwidths beyond which a kernel (below 1e-17) is not added.
_KERNEL_REACH = 9.0


def density_curve(df: DataFrame, value: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth, sample std) evaluated on
    ``points`` grid points from min-cut*bw to max+cut*bw.

    A fast Gauss transform: one aggregate sums the powers of each row's distance from the centre of its cell
    (one bandwidth wide), and each grid point adds up the Hermite expansions of the cells around it. The
    truncation error is at most 1e-15 of the kernel's height a row, so the curve is the direct sum to rounding. Only cells within reach of
    a grid point are kept: at most ``points`` * 20 of them, whatever the rows."""
    x = col(value).cast("double")
    src = df.select(x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    st = src.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_x").alias("s"),
                 F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    spark = df.sparkSession
    if not st["n"] or st["s"] is None or not 0 < st["s"] < math.inf:
        return spark.createDataFrame([], "x double, density double")
    n, lo, hi = st["n"], st["lo"], st["hi"]
    bw = st["s"] * n ** (-1.0 / 5.0)
    grid = np.linspace(lo - cut * bw, hi + cut * bw, points)
    step = grid[1] - grid[0] if points > 1 else 1.0
    nearest = F.lit(float(grid[0])) + F.round((F.col("_x") - float(grid[0])) / float(step)) * float(step)
    cell = F.floor((F.col("_x") - lo) / bw)
    u = (F.col("_x") - (lo + (F.col("cell") + 0.5) * bw)) / (bw * math.sqrt(2))
    rows = src.where(F.abs(F.col("_x") - nearest) <= _KERNEL_REACH * bw).select("_x", cell.alias("cell")).select("cell", u.alias("u"))
    found = rows.groupBy("cell").agg(*[F.sum(F.pow("u", F.lit(k))).alias(f"m{k}") for k in range(_HERMITE_TERMS)]).toPandas()
    centres = lo + (found["cell"].to_numpy(float) + 0.5) * bw
    moments = found[[f"m{k}" for k in range(_HERMITE_TERMS)]].to_numpy(float)
    v = (grid[:, None] - centres[None, :]) / (bw * math.sqrt(2))
    before, now = np.zeros_like(v), np.where(np.abs(v) * math.sqrt(2) <= _KERNEL_REACH + 1, np.exp(-v * v), 0.0)
    total = np.zeros(len(grid))
    for k in range(_HERMITE_TERMS):  # Hermite functions by their recurrence
        total += now @ (moments[:, k] / math.factorial(k))
        before, now = now, 2 * v * now - 2 * k * before
    density = total / (n * bw * math.sqrt(2 * math.pi))
    return spark.createDataFrame([(float(g), float(d)) for g, d in zip(grid, density)], "x double, density double")


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """2-D equal-width bin counts of (x, y) -- the data of an
    actual-vs-predicted or residual scatter plot, bounded in size."""
    X, Y = col(x).cast("double"), col(y).cast("double")
    src = df.select(X.alias("_x"), Y.alias("_y")).filter(
        F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    mm = src.agg(F.min("_x").alias("a"), F.max("_x").alias("b"),
                 F.min("_y").alias("c"), F.max("_y").alias("d"))
    xa, xb, ya, yb = (mm.select(k).scalar() for k in "abcd")

    def bucket(v, lo, hi):
        span = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
        return F.least(F.floor((v - lo) * (F.lit(float(bins)) / span)).cast("long"), F.lit(bins - 1))
    return (src.select(bucket(F.col("_x"), xa, xb).alias("x_bin"), bucket(F.col("_y"), ya, yb).alias("y_bin"))
            .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count")))
