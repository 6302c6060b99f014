"""Features and linear grids of all folds from a few passes: the same models and errors as fold by fold."""

import dataclasses

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shoplane.operators import folds, frequent
from shoplane.operators.features import TfidfTop
from shoplane.operators.models import REGISTRY, compare_models, time_series_grid_search
from shoplane.operators.ordered import time_segments
from shoplane.plans.workflow import NUMERIC, duration_stages

WORDS = ["brake", "pads", "worn", "chain", "fixed", "wheel", "tube", "light"]


def _rows(spark, n=240):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        text = None if i % 4 == 0 else " ".join(rng.choice(WORDS[: 4 + i // 60], 1 + i % 5))
        brand = None if i % 11 == 0 else ["A", "B", "C"][i % 3] if i < 150 else "late"
        rows.append((i, text, 2020 + i // 100, None if i % 13 == 0 else 1 + i % 12, 1 + i % 50, i % 7, 1.0 + i % 4 if i % 17 else float("nan"), int(i % 7 > 4),
                     brand, "E-Scooter", "Shop %d" % (i % 2), float(rng.normal() * 3 + i % 5 + (10 if brand == "A" else 0))))
    df = spark.createDataFrame(rows, "id long, Processed_Repair_Description string, Year int, Month int, WeekOfYear int, DayOfWeek int, Quarter double, IsWeekend int, "
                                     "`Brand and model` string, Type string, Shop string, label double").repartition(3)
    return time_segments(df, ["id"], 5, "_segment")


@pytest.mark.parametrize("name", ["Linear Regression", "Ridge Regression", "Lasso Regression", "Elastic Net"])
def test_same_models_as_fold_by_fold(spark, name, monkeypatch):
    df, n = _rows(spark)
    df = df.checkpoint()
    spec = dataclasses.replace(REGISTRY[name], grid=REGISTRY[name].grid[:2])
    got = time_series_grid_search(df, n, lambda est: duration_stages(est, 5), spec, segment_col="_segment")
    monkeypatch.setattr(folds.FoldPlan, "of", classmethod(lambda cls, *a: None))
    want = time_series_grid_search(df, n, lambda est: duration_stages(est, 5), spec, segment_col="_segment")
    assert got[1] == want[1]
    for a, b in zip(got[3], want[3]):
        assert a["cv_mae"] == pytest.approx(b["cv_mae"], rel=1e-6)
    assert [type(s) for s in got[0].stages] == [type(s) for s in want[0].stages]
    assert NUMERIC == want[0].stages[1].getInputCols()
    rows = [[(r.id, r.f, r.prediction) for r in m.transform(df).select("id", vector_to_array("features").alias("f"), "prediction").orderBy("id").collect()] for m in (got[0], want[0])]
    for a, b in zip(*rows):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9) and a[2] == pytest.approx(b[2], rel=1e-5, abs=1e-5)


def test_passes_over_the_rows_do_not_grow_with_folds_and_models(spark):
    df, n = _rows(spark)
    df = df.checkpoint()
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def read(x):
        seen.add(1)
        return x

    counted = df.withColumn("label", read.asNondeterministic()(F.col("label")))
    compare_models(counted, df.where("id > 200"), n, lambda est: duration_stages(est, 5), ["Linear Regression", "Ridge Regression"], 5, segment_col="_segment")
    assert seen.value <= 10 * n


def test_terms_of_all_folds(spark):
    df, _ = _rows(spark)
    df = df.withColumn("t", TfidfTop.tokens(F.col("Processed_Repair_Description"))).checkpoint()
    for first in (None, 1):
        got = frequent.fold_top_terms(df, F.col("t"), "_segment", [1, 3, 6], 3, buckets=16, first=first)
        assert got == [frequent.top_terms(df.where(F.col("_segment") < f), F.col("t"), 3) for f in (1, 3, 6)]
    counts = frequent.fold_document_counts(df, F.col("t"), "_segment", [1, 3, 6], WORDS)
    for f, (n, held) in zip((1, 3, 6), counts):
        m, some = frequent.document_counts(df.where(F.col("_segment") < f), F.col("t"), WORDS)
        assert (n, {w: k for w, k in held.items() if k}) == (m, some)


def test_constant_columns(spark, monkeypatch):
    df, n = _rows(spark, 60)
    df = df.withColumn("Processed_Repair_Description", F.lit("brake pads")).withColumn("Year", F.lit(2021)).withColumn("Quarter", F.lit(0.1)).checkpoint()
    got = time_series_grid_search(df, n, lambda est: duration_stages(est, 5), REGISTRY["Ridge Regression"], segment_col="_segment")
    monkeypatch.setattr(folds.FoldPlan, "of", classmethod(lambda cls, *a: None))
    want = time_series_grid_search(df, n, lambda est: duration_stages(est, 5), REGISTRY["Ridge Regression"], segment_col="_segment")
    assert [r["cv_mae"] for r in got[3]] == pytest.approx([r["cv_mae"] for r in want[3]], rel=1e-6)
    assert got[0].stages[-1].coefficients.toArray().tolist() == pytest.approx(want[0].stages[-1].coefficients.toArray().tolist(), rel=1e-6, abs=1e-9)


def test_durations_of_computed_dates_are_compiled(spark):
    import datetime as dt
    import re
    from shoplane.functions.dates import repair_duration
    from shoplane.operators.filters import drop_nulls, remove_outliers
    start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.range(200).select(F.when(F.col("id") > 0, F.timestamp_add("HOUR", F.col("id").cast("int") * 7 - 70, F.lit(dt.datetime(1995, 1, 1)))).cast("timestamp_ntz").alias("d"), "id")
    days = F.floor(F.greatest(repair_duration(start, F.col("d")), F.lit(0)) * F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.5))
    df = df.select("id", "d", start.alias("Date In"), (start + F.make_dt_interval(days.cast("int"))).alias("Date"))
    rows = df.withColumn("Repair Duration", repair_duration(F.col("`Date In`"), F.col("Date")))
    kept = remove_outliers(drop_nulls(rows, ["Repair Duration"]), "Repair Duration", 3.0, stats=(10.0, 1000.0))
    text = df._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "codegen")
    # the JVM leaves methods of more than 8,000 bytes uncompiled
    assert all(int(size) < 8000 for size in re.findall(r"maxMethodCodeSize:(\d+)", text))
    assert {r.id: r["Repair Duration"] for r in kept.collect()} == {i: int(max((i * 7 - 70) // 24, 0) * (1.0 if i % 2 == 0 else 0.5)) if i else 0 for i in range(200)}
    plain = spark.range(1, 200).select(repair_duration(start, F.timestamp_add("HOUR", F.col("id").cast("int") * 7 - 700, F.lit(dt.datetime(1995, 1, 1))).cast("timestamp_ntz")).alias("x"), "id")
    assert {r.id: r.x for r in plain.collect()} == {i: max((i * 7 - 700) // 24, 0) for i in range(1, 200)}
    assert spark.range(1).select(repair_duration(start, F.lit(None).cast("timestamp_ntz"))).first()[0] is None


def test_scaling_is_no_array_function(spark):
    from pyspark.ml.linalg import Vectors
    from shoplane.operators.features import PopStandardScalerModel
    df = spark.createDataFrame([(Vectors.dense([3.0, 5.0]),), (Vectors.sparse(2, [1], [7.0]),)], ["x"])
    out = PopStandardScalerModel(inputCol="x", outputCol="z", mean=[1.0, 5.0], std=[2.0, 1.0]).transform(df)
    assert "zip_with" not in df._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "extended")
    assert [r.z.toArray().tolist() for r in out.collect()] == [[1.0, 0.0], [-0.5, 2.0]]


def test_dependent_slots_get_the_smallest_coefficients(spark, tmp_path):
    from pyspark.ml import PipelineModel
    df, n = _rows(spark, 150)
    df = df.checkpoint()
    plan = folds.FoldPlan.of(duration_stages(REGISTRY["Linear Regression"].build({}, {}), 5).getStages()[:-1], df)
    fits = folds.FoldFits(plan, df, 5, "label", "_segment")
    moments = fits.moments[6][0]
    vary = np.flatnonzero(np.diag(moments.sums)[1:-1] > 0) + 1
    assert folds._dependent(moments.sums[np.ix_(vary, vary)]) and not folds._dependent(moments.sums[np.ix_(vary[:4], vary[:4])])
    model = fits.fit(REGISTRY["Linear Regression"].build({}, {}))
    x = np.array([r[0] for r in PipelineModel(stages=fits.stages()).transform(df).select(vector_to_array("features")).collect()])
    y = np.array([r[0] for r in PipelineModel(stages=fits.stages()).transform(df).select("label").collect()])
    std = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    want = np.linalg.lstsq((x - x.mean(axis=0)) / std, y - y.mean(), rcond=1e-9)[0] / std
    assert model.coefficients.toArray().tolist() == pytest.approx(want.tolist(), abs=1e-3)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = type(model).load(str(tmp_path / "m"))
    assert loaded.coefficients == model.coefficients and loaded.getFeaturesCol() == "features" and loaded.getTol() == 1e-12
