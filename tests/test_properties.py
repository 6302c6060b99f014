"""Property tests: coercion against a Python reference; join multiplicity."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoplane.functions import coerce as C
from shoplane.operators.joins import merge_on
from tests.conftest import SF_SMALL


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False),
                min_size=1, max_size=200))
def test_quantity_and_money_match_reference(spark, values):
    rows = [(repr(v), "${:,.2f}".format(v) if v >= 0 else None) for v in values]
    df = spark.createDataFrame(rows, "q string, m string")
    got = df.select(C.to_quantity("q").alias("q"), C.money_to_double("m").alias("m")).collect()
    for v, r in zip(values, got):
        assert r.q == math.trunc(float(repr(v)))                  # truncation toward zero
        if v >= 0:
            assert r.m == float("{:.2f}".format(v))


def test_merge_row_count_is_sum_of_key_products(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey")
    od = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey")
    # duplicate the orders side so keys really multiply
    od2 = od.unionByName(od.filter(F.col("o_orderkey") % 2 == 0))
    a = li.groupBy(F.col("l_orderkey").alias("k")).count().withColumnRenamed("count", "a")
    b = od2.groupBy(F.col("o_orderkey").alias("k")).count().withColumnRenamed("count", "b")
    expected = a.join(b, "k").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    assert merge_on(li, od2, "l_orderkey", "o_orderkey").count() == expected
