"""ML stages: TF-IDF formula, scaler, imputers, one-hot, persistence, models."""

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shoplane.operators.features import (CastToFloat32, FeatureEngineer, ModeImputer, PopStandardScaler,
                                         TextPreprocessor, TfidfTop)


def test_tfidf_formula(spark):
    docs = spark.createDataFrame([("apple banana apple",), ("banana cherry",), ("",)], "t string")
    m = TfidfTop(inputCol="t", outputCol="v", maxFeatures=2).fit(docs)
    assert m.getOrDefault("vocabulary") == ["apple", "banana"]       # cherry cut (tf 1), alphabetical
    n = 3
    idf_a, idf_b = math.log((1 + n) / 2) + 1, math.log((1 + n) / 3) + 1
    v = [r.v.toArray().tolist() for r in m.transform(docs).collect()]
    w = [2 * idf_a, idf_b]
    norm = math.sqrt(sum(x * x for x in w))
    assert v[0] == pytest.approx([w[0] / norm, w[1] / norm])
    assert v[1] == pytest.approx([0.0, 1.0])
    assert v[2] == pytest.approx([0.0, 0.0])


def test_pop_scaler_and_zero_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    v = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)
    out = PopStandardScaler(inputCol="x", outputCol="z").fit(v).transform(v)
    z = [r.z.toArray().tolist() for r in out.collect()]
    assert z == [[-1.0, 0.0], [1.0, 0.0]]


def test_mode_imputer_ties_smallest_and_all_null(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), ("b", None), ("a", None)],
                               "c string, allnull string")
    m = ModeImputer(inputCols=["c", "allnull"]).fit(df)
    got = [(r.c, r.allnull) for r in m.transform(df).collect()]
    assert got[2] == ("a", None)


def test_feature_engineer_and_cast(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2021, 1, 3), 1.0)], "`Date In` timestamp_ntz, x double")
    r = FeatureEngineer(dateCol="Date In").transform(df).first()
    assert (r.Year, r.Month, r.WeekOfYear, r.DayOfWeek, r.Quarter, r.IsWeekend) == (2021, 1, 53, 6, 1, 1)
    c = CastToFloat32(inputCols=["x"]).transform(df)
    assert dict(c.dtypes)["x"] == "float"


def test_feature_engineer_lags(spark):
    import datetime as dt
    rows = [(dt.datetime(2021, 1, i), i, float(i)) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "`Date In` timestamp_ntz, row_id int, `Repair Duration` double")
    out = FeatureEngineer(dateCol="Date In", orderCols=["Date In", "row_id"], withLags=True,
                          rowsPerBucket=3).transform(df).orderBy("row_id").collect()
    assert [r.lag_1 for r in out] == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]   # first row back-filled
    assert [r.rolling_mean_3 for r in out][:3] == [2.0, 2.0, 2.0]


def test_pipeline_roundtrip_and_unseen_category(spark, tmp_path):
    import datetime as dt
    from shoplane.operators.models import REGISTRY
    from shoplane.plans.workflow import full_stages
    rows = []
    for i in range(60):
        rows.append((dt.datetime(2021, 1, 1 + i % 28), f"fixed brake {i % 3}", "note", ["A", "B"][i % 2],
                     "E-Scooter", "Shop 1", float(i % 7)))
    cols = ("`Date In` timestamp_ntz, Repair_Description string, x string, `Brand and model` string, "
            "Type string, Shop string, label double")
    df = spark.createDataFrame(rows, cols)
    model = full_stages(REGISTRY["Linear Regression"].build({}, {}), max_features=5).fit(df)
    p = str(tmp_path / "m")
    model.write().overwrite().save(p)
    loaded = PipelineModel.load(p)
    a = [r.prediction for r in model.transform(df).collect()]
    b = [r.prediction for r in loaded.transform(df).collect()]
    assert a == pytest.approx(b)
    unseen = spark.createDataFrame([(dt.datetime(2021, 2, 1), "brake", "n", "ZZZ", "Other", "Shop 9", 0.0)], cols)
    r = loaded.transform(unseen).first()
    assert r.prediction == r.prediction      # not NaN
    ohe = r["Brand and model__ohe"].toArray().tolist()
    assert ohe == [0.0] * len(ohe)


def test_text_preprocessor_persists(spark, tmp_path):
    tp = TextPreprocessor(inputCol="a", outputCol="b", stopWords=["x"])
    p = str(tmp_path / "tp")
    tp.save(p)
    assert TextPreprocessor.load(p).getOrDefault("stopWords") == ["x"]


def test_one_feature_ols_matches_closed_form(spark):
    from shoplane.operators.models import REGISTRY
    df = spark.createDataFrame([(float(x), 2.0 * x + 1.0 + (0.1 if x % 2 else -0.1)) for x in range(20)],
                               "x double, label double")
    v = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    m = REGISTRY["Linear Regression"].build({}, {}).fit(v)
    s = df.agg(F.regr_slope("label", "x"), F.regr_intercept("label", "x")).first()
    assert m.coefficients[0] == pytest.approx(s[0]) and m.intercept == pytest.approx(s[1])


def test_grid_search_time_folds(spark):
    from pyspark.ml.regression import LinearRegression
    from shoplane.operators.models import ModelSpec, time_series_grid_search
    df = spark.range(0, 120).select((F.col("id")).alias("row_idx"), F.col("id").cast("double").alias("x"),
                                    (F.col("id") * 3.0).alias("label"))

    def stages(est):
        return Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), est])
    spec = ModelSpec("ridge", lambda p, s: LinearRegression(regParam=p["r"], labelCol="label"),
                     [{"r": 0.0}, {"r": 10.0}])
    model, best, cv, results = time_series_grid_search(df, 120, stages, spec, 5, "row_idx", "label", 2)
    assert best == {"r": 0.0} and cv < 1e-6 and len(results) == 2
