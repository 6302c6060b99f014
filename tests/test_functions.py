"""Scalar expressions (X*, P5-P9) on golden edge rows (FIXTURES.md)."""

import datetime as dt

from pyspark.sql import functions as F

from shoplane.functions import coerce as C
from shoplane.functions import dates as D
from shoplane.functions import text as X


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("r")).first()["r"]


def test_note_header_strip(spark):
    note = "Zoë Marlow (18/12/2021 18:16:23)\nCustomer wants a bell.\nCheck the rack."
    assert one(spark, X.strip_note_header, note) == "Customer wants a bell.\nCheck the rack."
    iso = "(2021-11-15) Tobin rest of line"
    assert one(spark, X.strip_note_header, iso) == "rest of line"
    # bare \r does not start a line (only \n does)
    assert one(spark, X.strip_note_header, "a\rJohn Smith (1/2/2021 10:11:12) x") == \
        "a\rJohn Smith (1/2/2021 10:11:12) x"
    assert one(spark, X.strip_note_header, None) is None


def test_prefix_and_descriptors(spark):
    assert one(spark, X.strip_prefix, "EBK-Trek FX") == "-Trek FX"
    assert one(spark, X.strip_prefix, "es Ninebot G30") == "Ninebot G30"
    assert one(spark, X.strip_prefix, "Espin Nesta") == "pin Nesta"          # faithful, no boundary
    assert one(spark, lambda c: X.strip_prefix(c, word_boundary=True), "Espin Nesta") == "Espin Nesta"
    # "_" is a word character, so "Edition_2" holds no whole-word "Edition"
    assert one(spark, X.remove_descriptors, "Trek  FX Black-Edition_2") == "Trek FX Edition 2"
    assert one(spark, X.remove_descriptors, "Gotrax GXL V2 Pro") == "Gotrax GXL"
    assert one(spark, X.remove_descriptors, "Blackbird") == "Blackbird"      # whole words only


def test_text_preprocessing(spark):
    r = one(spark, X.preprocess_text, "The Brakes were squeaking!! cannot fix 2 boxes, wanna see?")
    assert r == "brake squeaking fix box wan na see"
    assert one(spark, X.preprocess_text, None) == ""
    assert one(spark, X.preprocess_text, "Ça coûte 12€") == "cote"     # "ç" dropped, "a" is a stop word


def test_money_and_quantities(spark):
    assert one(spark, C.money_to_double, "$1,234.50") == 1234.5
    for bad in ["(5)", "12d", "abc", None]:
        assert one(spark, C.money_to_double, bad) is None
    assert one(spark, C.to_quantity, "3.9") == 3
    assert one(spark, C.to_quantity, "-2.5") == -2
    assert one(spark, C.to_quantity, "NaN") == 0
    assert one(spark, C.to_quantity, "12d") == 0
    assert one(spark, C.to_dollars, "x") == 0.0
    assert one(spark, C.to_text, None) is None


def test_timestamps(spark):
    lenient = lambda c: C.to_ts(c, strict=False)
    assert one(spark, lenient, "2021-01-03 10:00:00") == dt.datetime(2021, 1, 3, 10, 0)
    assert one(spark, lenient, "1/3/2021") == dt.datetime(2021, 1, 3)
    assert one(spark, lenient, "not a date") is None


def test_dates(spark):
    rows = [(dt.datetime(2021, 1, 3, 23, 0), dt.datetime(2021, 1, 4, 22, 0)),
            (dt.datetime(2021, 1, 5, 0, 0), dt.datetime(2021, 1, 3, 0, 0)),
            (None, dt.datetime(2021, 1, 3))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    out = df.select(D.whole_days_between("a", "b").alias("d"), D.repair_duration("a", "b").alias("r"),
                    D.iso_week("a").alias("w"), D.day_of_week("a").alias("dow"),
                    D.is_weekend("a").alias("we")).collect()
    assert [(r.d, r.r) for r in out] == [(0, 0), (-2, 0), (None, None)]
    assert (out[0].w, out[0].dow, out[0].we) == (53, 6, 1)


def test_json_struct(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("brand", T.StringType()), T.StructField("model", T.StringType())])
    df = spark.createDataFrame([('{"brand": "Trek", "model": "FX"}',), ('{"brand": "Trek"}',),
                                ("not json",), ('["a"]',), ('{"brand": null, "model": "x"}',)], "x string")
    got = [r.s for r in df.select(C.parse_json_struct(F.col("x"), schema).alias("s")).collect()]
    assert got[0].brand == "Trek" and got[1] is None and got[2] is None and got[3] is None
    assert got[4] is not None and got[4].brand is None
