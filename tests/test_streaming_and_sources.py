"""Streaming use of the stateless operators; record sources; model registry."""

import datetime as dt

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from shoplane.session import scratch_path


def test_enrich_stream_memory_sink(spark):
    from shoplane.streaming.stateless import enrich_stream
    rows = [("2021-01-03 23:00:00", "2021-01-04 22:00:00",
             "fix brake\nAnna Berg (3/1/2021 10:00:00)"),
            ("2021-01-05", "2021-01-03", None)]
    src = spark.createDataFrame(rows, "`Date In` string, `Date` string, note string")
    path = scratch_path(spark, "stream-src")
    src.write.parquet(path)
    stream = spark.readStream.schema(src.schema).parquet(path)
    q = (enrich_stream(stream, note_col="note").writeStream.format("memory")
         .queryName("enriched").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM enriched ORDER BY `Date In`").collect()
    assert [r["Repair Duration"] for r in out] == [0, 0]
    assert out[0]["Note Author"] == "Anna Berg" and out[0]["WeekOfYear"] == 53


def test_records_to_df(spark):
    from shoplane.sources import records_to_df
    df = records_to_df(spark, {"Date In": "2024-10-05", "Type": "E-Scooter"}, "`Date In` string, Type string, Shop string")
    r = df.first()
    assert (r["Date In"], r.Type, r.Shop) == ("2024-10-05", "E-Scooter", None)


@pytest.mark.parametrize("name", ["Linear Regression", "Ridge Regression", "Lasso Regression", "Elastic Net",
                                  "Decision Tree", "Random Forest", "Gradient Boosting"])
def test_registry_models_fit(spark, name):
    from shoplane.operators.models import REGISTRY, label_stats
    df = spark.range(0, 60).select(F.col("id").cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"),
                                   (F.col("id") * 2.0 + 1).alias("label"))
    v = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df)
    spec = REGISTRY[name]
    params = dict(spec.grid[0])
    if "n_estimators" in params:
        params["n_estimators"] = 3
    m = spec.build(params, label_stats(v)).fit(v)
    assert m.transform(v).filter(F.isnan("prediction")).count() == 0


def test_score_records(spark):
    from shoplane.operators.models import REGISTRY
    from shoplane.plans.workflow import full_stages, score_records
    rows = [(dt.datetime(2021, 1, 1 + i % 28), f"brake {i % 3}", "n", "A", "E-Scooter", "S", float(i % 5))
            for i in range(40)]
    df = spark.createDataFrame(rows, "`Date In` timestamp_ntz, Description string, "
                               "`Cleaned Work Order Internal Note` string, `Brand and model` string, Type string, "
                               "Shop string, label double")
    df = df.withColumn("Repair_Description", F.concat("Description", F.lit(" "), "`Cleaned Work Order Internal Note`"))
    model = full_stages(REGISTRY["Linear Regression"].build({}, {}), max_features=5).fit(df)
    rec = {"Date In": "2024-10-05", "Description": "Tightened the bell.", "Cleaned Work Order Internal Note": "ok",
           "Brand and model": "Fernway Sparrow", "Type": "E-Scooter", "Shop": "S"}
    schema = ("`Date In` string, Description string, `Cleaned Work Order Internal Note` string, "
              "`Brand and model` string, Type string, Shop string")
    p = score_records(spark, model, rec, schema).first().prediction
    assert p == p
