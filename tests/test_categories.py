"""Wide categories: codes as StringIndexer's, kept in a table, named by a join."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from shoplane.operators.categories import CategoryIndexer
from shoplane.operators.models import coefficients


def test_codes_equal_the_label_list(spark):
    rows = [(i, ["b", "a", "é", None, "", "Z"][i % 6], f"v{i % 37}" if i % 3 else "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x string, y string").repartition(4)
    late = spark.createDataFrame([(1000, "new", "v1"), (1001, None, "?")], df.schema)
    ours = CategoryIndexer(inputCols=["x", "y"], outputCols=["i", "j"], rowsPerBucket=7).fit(df)
    theirs = StringIndexer(inputCols=["x", "y"], outputCols=["i", "j"], handleInvalid="keep", stringOrderType="alphabetAsc").fit(df)
    for some in (df, late):
        for limit in (32 << 20, 0):  # broadcast, and joined by shuffle
            ours.set(ours.broadcastBytes, limit)
            assert sorted(map(tuple, ours.transform(some).collect())) == sorted(map(tuple, theirs.transform(some).collect()))
    encode = OneHotEncoder(inputCols=["j"], outputCols=["w"], dropLast=True)  # the label list can't encode the empty text of x
    a, b = (encode.fit(m.transform(df)).transform(m.transform(df.unionByName(late))) for m in (ours, theirs))
    assert sorted((r.id, str(r.w)) for r in a.collect()) == sorted((r.id, str(r.w)) for r in b.collect())
    empty = CategoryIndexer(inputCols=["x"], outputCols=["i"]).fit(df.limit(0))
    assert {r.i for r in empty.transform(df).collect()} == {0.0}


def test_a_hundred_thousand_categories(spark, tmp_path):
    n = 100_000
    df = spark.range(0, 2 * n, 1, 8).select((F.col("id") % n).alias("k"), F.concat(F.lit("shop "), F.lpad((F.col("id") % n).cast("string"), 6, "0")).alias("shop"))
    df = df.withColumn("label", F.when(F.col("k") % 2 == 0, 10.0).otherwise(0.0))
    stages = [CategoryIndexer(inputCols=["shop"], outputCols=["i"], rowsPerBucket=30_000), OneHotEncoder(inputCols=["i"], outputCols=["v"], dropLast=True),
              VectorAssembler(inputCols=["v"], outputCol="features"), LinearRegression(maxIter=5, regParam=1e-9)]
    model = Pipeline(stages=stages).fit(df)
    model.save(str(tmp_path / "m"))
    model = PipelineModel.load(str(tmp_path / "m"))
    assert "shop 0" not in str(model.stages[0].extractParamMap()) and model.stages[0].getOrDefault("sizes") == [n]
    scored = model.transform(df)
    coef = coefficients(model, scored).where("feature <> 'intercept'")
    got = coef.agg(F.count("*").alias("n"), F.min("feature").alias("lo"), F.max("feature").alias("hi"),
                   F.min(F.when(F.col("feature").substr(-1, 1).isin(list("02468")), F.col("coefficient"))).alias("even"),
                   F.max(F.when(F.col("feature").substr(-1, 1).isin(list("13579")), F.col("coefficient"))).alias("odd")).first()
    assert (got.n, got.lo, got.hi) == (n, "v_shop 000000", "v_shop 099999") and got.even > got.odd
