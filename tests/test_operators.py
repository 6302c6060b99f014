"""DataFrame operators against hand-checked expectations and invariants."""

import datetime as dt

import pytest
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from shoplane.operators import filters as FL
from shoplane.operators import metrics as M
from shoplane.operators import schema as S
from shoplane.operators.joins import merge_on, union_by_name


def test_trim_and_require(spark):
    df = spark.createDataFrame([(1, "a")], "`Brand and model ` int, ` Type` string")
    t = S.trim_column_names(df)
    assert t.columns == ["Brand and model", "Type"]
    with pytest.raises(KeyError):
        S.require_columns(t, ["Shop"])
    with pytest.raises(ValueError):
        S.trim_column_names(spark.createDataFrame([(1, 2)], "`a ` int, ` a` int"))


def test_build_text_keeps_blank(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "Description string, Note string")
    r = S.build_text(df, "Repair_Description", "Description", "Note").collect()
    assert [x.Repair_Description for x in r] == ["a ", " "]


def test_merge_on_suffixes_and_multiplicity(spark):
    left = spark.createDataFrame([(1, "x", 10.0), (1, "y", 11.0), (2, "z", 12.0), (None, "n", 0.0)],
                                 "`WO#` bigint, Item string, Total double")
    right = spark.createDataFrame([(1, 100.0, "a"), (1, 101.0, "b"), (3, 1.0, "c"), (None, 5.0, "d")],
                                  "ID bigint, Total double, Status string")
    m = merge_on(left, right, "WO#", "ID")
    assert m.columns == ["WO#", "Item", "Total_x", "ID", "Total_y", "Status"]
    assert m.count() == 4                      # 2 x 2 for key 1, null keys never match
    assert merge_on(left, right, "WO#", "ID", null_safe=True).count() == 5


def test_outliers_strict_and_observed(spark):
    vals = [0.0] * 20 + [100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    obs = Observation("o")
    out = FL.remove_outliers(df, "x", 3.0, observation=obs)
    assert out.count() == 20
    assert obs.get == {"rows_in": 21, "rows_out": 20}
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert FL.remove_outliers(const, "x").count() == 0      # zero std drops all
    grouped = spark.createDataFrame([(g, float(v)) for g in ("a", None) for v in [0] * 20 + [100]],
                                    "g string, x double")
    kept = FL.remove_outliers(grouped, "x", 3.0, by=["g"])
    assert kept.count() == 40 and kept.filter("g IS NULL").count() == 20


def test_metrics_and_exact_median(spark):
    rows = [(1.0, 2.0), (2.0, 2.0), (0.0, 1.0), (4.0, 3.0)]
    df = spark.createDataFrame(rows, "y double, p double")
    m = M.regression_metrics(df, "y", "p").first()
    assert m.n == 4 and m.mae == pytest.approx(0.75)
    assert m.median_ae == pytest.approx(1.0)      # |e| = 1, 0, 1, 1
    assert m.mape == pytest.approx((1.0 + 0.0 + 0.25) / 3 * 100)
    const = spark.createDataFrame([(3.0, 3.0), (3.0, 3.0)], "y double, p double")
    c = M.regression_metrics(const, "y", "p").first()
    assert c.r2 == 1.0 and c.explained_variance == 1.0
    zeros = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    assert M.regression_metrics(zeros, "y", "p").first().mape is None


def test_exact_median_multi_round(spark):
    # force many passes and a hot value
    df = spark.range(0, 20001).select(F.when(F.col("id") % 3 == 0, F.lit(7.0))
                                      .otherwise(F.col("id").cast("double")).alias("v"),
                                      (F.col("id") % 2).alias("g"))
    got = M.exact_median(df, "v", digit_bits=4).first()["median"]
    exp = df.agg(F.median("v")).first()[0]
    assert got == pytest.approx(exp)
    by = {r.g: r.median for r in M.exact_median(df, "v", ["g"], digit_bits=4).collect()}
    exp_by = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert by == pytest.approx(exp_by)


def test_histogram_all_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "r double")
    h = M.residual_histogram(df, "r", 5).orderBy("bin").collect()
    assert [x["count"] for x in h] == [2, 2, 2, 2, 3]        # max lands in the last bin
    const = spark.createDataFrame([(2.0,), (2.0,)], "r double")
    h2 = M.residual_histogram(const, "r", 50).filter("count > 0").collect()
    assert len(h2) == 1 and h2[0]["bin"] == 25


def test_union_by_name(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "b")], "x int, y string")
    assert union_by_name([a, b]).count() == 2


@pytest.mark.parametrize("rows_per_bucket", [10_000_000, 400, 37])
def test_ordered_equals_single_partition(spark, rows_per_bucket):
    from shoplane.operators.ordered import ordered_features
    base = spark.range(0, 1500).select(
        F.col("id").alias("k"),
        # a third of the rows share one date (hot key); some dates are null
        F.when(F.col("id") % 3 == 0, F.lit(dt.datetime(2021, 1, 3)))
         .when(F.col("id") % 7 == 0, F.lit(None))
         .otherwise(F.expr("timestamp_ntz '2020-01-01 00:00:00' + make_interval(0, 0, 0, id % 97)"))
         .cast("timestamp_ntz").alias("d"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") * 1.5).alias("v"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"))
    for by, bcast in (([], 32 << 20), (["g"], 32 << 20), (["g"], 0)):
        res = ordered_features(base, ["d", "k"], by, index_col="idx", lag_col="v", lags=(1, 2),
                               rolling=3, rolling_name="r3", fill_cols=["v"],
                               rows_per_bucket=rows_per_bucket, summary_broadcast_bytes=bcast)
        w = Window.partitionBy(*by).orderBy(F.col("d").asc_nulls_last(), "k")
        rw = w.rowsBetween(-2, 0)
        ref = base.select(
            "k", (F.row_number().over(w) - 1).alias("e_idx"), F.lag("v", 1).over(w).alias("e1"),
            F.lag("v", 2).over(w).alias("e2"),
            F.when(F.count("v").over(rw) == 3, F.avg("v").over(rw)).alias("e3"),
            F.coalesce("v", F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
                       F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("ef"))
        j = res.join(ref, "k")
        assert j.count() == 1500
        bad = j.filter(~(F.col("idx").eqNullSafe(F.col("e_idx")) & F.col("lag_1").eqNullSafe(F.col("e1"))
                         & F.col("lag_2").eqNullSafe(F.col("e2")) & F.col("r3").eqNullSafe(F.col("e3"))
                         & F.col("v").eqNullSafe(F.col("ef"))))
        assert bad.count() == 0
        if by and not bcast:
            # summary join and window share one hash partitioning: the data
            # are exchanged once (plus the narrow summary and halo exchanges)
            plan = res._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(_gn0") <= 3


def test_time_split_and_folds(spark):
    from shoplane.operators.ordered import fold_frames, ordered_index, time_folds, time_split
    df = spark.range(0, 100).select(F.col("id").alias("k"), (F.col("id") % 10).alias("d"))
    train, test = time_split(df, ["d", "k"], 0.9, rows_per_bucket=30)
    assert train.count() == 90 and test.count() == 10
    assert train.agg(F.max("d")).first()[0] <= test.agg(F.min("d")).first()[0]
    assert time_folds(100, 5) == [(20, 20, 36), (36, 36, 52), (52, 52, 68), (68, 68, 84), (84, 84, 100)]
    ix = ordered_index(df, ["d", "k"], rows_per_bucket=30)
    sizes = [(tr.count(), te.count()) for tr, te in fold_frames(ix, 100, 5)]
    assert sizes == [(20, 16), (36, 16), (52, 16), (68, 16), (84, 16)]


@pytest.mark.parametrize("rows_per_bucket", [100_000, 400, 100])
def test_ordered_index_on_orders_table(spark, rows_per_bucket):
    """SURVEY §5 (4): index, lag 1/2 and forward fill on the orders table equal
    the single-partition window for 1, 4 and ~16 buckets."""
    from tests.conftest import SF_SMALL
    from shoplane.operators.ordered import ordered_features
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(
        "o_orderkey", "o_orderdate",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_totalprice")).alias("v"))
    r = ordered_features(o, ["o_orderdate", "o_orderkey"], None, index_col="i", lag_col="v", lags=(1, 2),
                         fill_cols=["v"], rows_per_bucket=rows_per_bucket)
    w = Window.orderBy("o_orderdate", "o_orderkey")
    ref = o.select("o_orderkey", (F.row_number().over(w) - 1).alias("ei"), F.lag("v", 1).over(w).alias("e1"),
                   F.lag("v", 2).over(w).alias("e2"),
                   F.coalesce("v", F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
                              F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("ef"))
    j = r.join(ref, "o_orderkey")
    assert j.count() == o.count()
    assert j.filter(~(F.col("i").eqNullSafe(F.col("ei")) & F.col("lag_1").eqNullSafe(F.col("e1"))
                      & F.col("lag_2").eqNullSafe(F.col("e2")) & F.col("v").eqNullSafe(F.col("ef")))).count() == 0
