"""Steps that grow with the rows only: stored rows are read again instead of the tables, and nothing is sent in a slow form."""

import datetime as dt
import re

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shoplane.operators import gram
from shoplane.operators.selection import cut_keys, segment
from shoplane.plans import workflow as WF


def _explained(df, mode="codegen"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_evaluation_rows_are_prepared_once(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day, day + dt.timedelta(days=900 if i == 0 else i % 5), "(n/a)" if i == 1 else "$9,000,000.00" if i == 2 else f"${i % 7}.50") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, `Date In` timestamp_ntz, Date timestamp_ntz, `Total_y ` string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(x):
        seen.add(1)
        return x

    counts = {}
    done = WF.prepare_evaluation(df.withColumn("Total_y ", read.asNondeterministic()(F.col("`Total_y `"))), counts=counts)
    assert {r.id for r in done.collect()} == set(range(3, 60)) and done.count() == 57
    assert counts == {"Repair Duration": 59, "Total_y": 58}
    assert seen.value == 60
    none = WF.prepare_evaluation(df.limit(0), counts=counts)
    assert none.count() == 0 and counts == {"Repair Duration": 0, "Total_y": 0}


def test_fold_bounds_are_compiled(spark):
    df = spark.range(3000).select((F.col("id") % 50).alias("a"), (F.col("id") % 7 / 100).alias("x"), (F.col("id") / 1000).alias("y"),
                                  F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"))
    order = ["a", "x", "y", "id"]
    _, keys = cut_keys(df, order, lambda n: [100 * k for k in range(1, 9)])
    rows = df.select("*", segment(df, order, keys).alias("s"))
    # the JVM leaves methods of more than 8,000 bytes uncompiled
    assert all(int(size) < 8000 for size in re.findall(r"maxMethodCodeSize:(\d+)", _explained(rows.where("s < 8"))))
    assert [r["count"] for r in rows.groupBy("s").count().orderBy("s").collect()] == [*[100] * 8, 2200]


def test_vectors_go_to_the_tasks_without_null_lists(spark):
    df = spark.createDataFrame([(s, Vectors.dense([1.0, s]) if s % 2 else Vectors.sparse(2, [0], [2.0]), float(s)) for s in range(4)], ["segment", "features", "label"])
    x = gram._columns(df, "features", "label", "segment")
    assert x.where("x.indices IS NULL OR x.values IS NULL").count() == 0
    m = gram.segment_moments(df.withColumn("segment", F.lit(0)))[0]
    np.testing.assert_allclose(m.centred()[0], [1.5, 1.0])


def test_formats_share_their_tests_and_find_the_same_times(spark):
    from shoplane.functions import coerce as C
    texts = ["1/5/2024", "13/5/2024", "2024-01-05", " 2024-1-5", "1/5/2024 7:08:09", "1/5/2024 7:08", "1/5/2024 7:08 PM", "16/12/2024 1:02:03 am", "2024-01-05T07:08:09",
             "2024/01/05", "05-01-2024", "7:08", "n/a", "", None, "a:b/c-d", "5.1.2024", "20240105 0708"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    formats = [*C.DEFAULT_TIMESTAMP_FORMATS, "dd-MM-yyyy", "d.M.yyyy", "yyyyMMdd HHmm", "d/M/yyyy", "H:mm 'h'"]
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)).cast("timestamp_ntz") for f in formats])
    for got, want in df.select(C.to_ts("t", strict=False, formats=formats), plain).collect():
        assert got == want
    typed = df.select(C.to_ts("t", strict=False).alias("v"))
    assert sum(r.v is not None for r in typed.collect()) == 9
    plan = _explained(typed, "extended").split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].lower()
    assert plan.count("contains(t") >= 6  # a text without the separators is given to no parser


def test_held_words_count_keys_once(spark):
    from shoplane.operators.lemmas import cleaned_tokens, held_words, preprocess_with_lexicon
    rows = [(1, ["a", "a", "b"]), (2, ["a"]), (2, ["a", "c"]), (3, None), (None, ["a", "b"]), (None, ["a"]), (4, [])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    assert {r.word: r.n for r in held_words(df, "t", "k").collect()} == {"a": 3, "b": 2, "c": 1}
    texts = spark.createDataFrame([(1, "The wolves' boxes, boxes"), (2, None), (3, "wolf box")], "k long, t string")
    lexicon = spark.createDataFrame([("wolf",), ("box",)], "lemma string")
    want = {1: "wolf box box", 2: "", 3: "wolf box"}
    stored = texts.select("k", cleaned_tokens(F.col("t")).alias("t")).checkpoint(eager=True)
    for source in (texts, stored):
        assert {r.k: r.out for r in preprocess_with_lexicon(source, "t", "out", "k", lexicon).collect()} == want


def test_models_share_the_fitted_stages_of_a_fold(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from shoplane.operators.features import TfidfTop
    from shoplane.operators.models import REGISTRY, time_series_grid_search
    df = spark.range(120).select(F.col("id").alias("row_idx"), (F.col("id") % 11).cast("double").alias("a"), (F.col("id") % 7 + F.col("id") / 9).alias("label")).checkpoint()
    shared = {}

    def stages(est):
        return Pipeline(stages=[Imputer(strategy="mean", inputCols=["a"], outputCols=["b"]), VectorAssembler(inputCols=["b"], outputCol="features"), est])

    first = time_series_grid_search(df, 120, stages, REGISTRY["Ridge Regression"], 2, shared=shared)
    fitted = dict(shared)
    assert len(fitted) == 6  # stages and statistics of two folds and of all rows
    second = time_series_grid_search(df, 120, stages, REGISTRY["Ridge Regression"], 2, shared=shared)
    assert shared == fitted and first[1:] == second[1:]
    assert first[3] == time_series_grid_search(df, 120, stages, REGISTRY["Ridge Regression"], 2)[3]
    texts = spark.createDataFrame([(1, "Brake pads brake"), (2, None), (3, "pads a worn")], "id long, t string")
    arrays = texts.select("id", TfidfTop.tokens(F.col("t")).alias("t"))
    a, b = (TfidfTop(inputCol="t", outputCol="v", maxFeatures=3).fit(x) for x in (texts, arrays))
    assert a.getOrDefault("vocabulary") == b.getOrDefault("vocabulary") == ["brake", "pads", "worn"] and a.getOrDefault("idf") == b.getOrDefault("idf")
    assert a.transform(texts).select("id", "v").collect() == b.transform(arrays).select("id", "v").collect() == b.transform(texts).select("id", "v").collect()
