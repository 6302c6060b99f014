"""Brand matching, note splitting, extraction, dictionary source."""

import pytest

from pyspark.sql import functions as F

from shoplane.operators.brands import BRAND_MODEL, clean_brand_model, match_brand
from shoplane.operators.extract import extract_struct
from shoplane.operators.notes import note_fallback, split_note
from shoplane.session import scratch_path
from shoplane.sources import read_brand_dictionary


DICT_TEXT = """Known E-Scooter brands:
Ninebot
Zeta-Wheel
Velo Craft

Known Bicycle brands:
Fuji Bikes
Trek
Velo Craft
Old Marque (defunct)
"""


def write_dictionary(spark, tmp_path):
    p = tmp_path / "brands.txt"
    p.write_text(DICT_TEXT)
    return read_brand_dictionary(spark, str(p))


def test_dictionary_sections_and_aliases(spark, tmp_path):
    d = write_dictionary(spark, tmp_path)
    rows = {(r.brand, r.section, r.norm) for r in d.collect()}
    assert ("Velo Craft", "E-Scooter", "velo craft") in rows
    assert ("Velo Craft", "Bicycle", "velo craft") in rows
    assert ("Fuji Bikes", "Bicycle", "fuji") in rows           # alias without the generic tail
    assert ("Zeta-Wheel", "E-Scooter", "zeta wheel") in rows
    assert ("Old Marque (defunct)", "Bicycle", "old marque") in rows


def test_match_brand(spark, tmp_path):
    d = write_dictionary(spark, tmp_path)
    df = spark.createDataFrame([("Fuji Feather Petina",), ("Ninebot G30 Max",), ("Trek FX 7.4",),
                                ("Custom Bike",), ("zeta-wheel Z10",), ("",), (None,),
                                ("Trek FX 7.4",)], "t string")
    got = [(r.bm.brand, r.bm.model) for r in match_brand(df, "t", d, out="bm").collect()]
    assert sorted(got, key=str) == sorted([("Fuji Bikes", "Feather Petina"), ("Ninebot", "G30 Max"),
                                           ("Trek", "FX 7.4"), ("Unknown", "Custom Bike"),
                                           ("Zeta-Wheel", "Z10"), ("", ""), ("", ""),
                                           ("Trek", "FX 7.4")], key=str)


def test_clean_brand_model_chain(spark, tmp_path):
    d = write_dictionary(spark, tmp_path)
    df = spark.createDataFrame([("EBK Trek FX Black Edition",), ("es ninebot g30 pro",)], "`Brand and model ` string")
    r = clean_brand_model(df, "Brand and model ", d).collect()
    assert [(x["Cleaned Brand"], x["Cleaned Model"]) for x in r] == [("Trek", "FX"), ("Ninebot", "g30")]


def test_clean_brand_model_boundaries(spark):
    names = ["Espin", "Green Bike", "Swift Folder", "Time", "Trek"]
    d = spark.createDataFrame([(n, "Bicycle", n.lower()) for n in names], "brand string, section string, norm string")
    rows = {"Espin Sport": ("Espin", "Sport"), "Green Bike GB1": ("Green Bike", "GB1"),
            "BK-Swift Folder 8 black": ("Swift Folder", "8"), "old part time bike": ("Unknown", "old part time bike"),
            "Time Edge non-motor": ("Time", "Edge"), "Green black Bike": ("Unknown", "Bike"),
            "black": ("", ""), " \n": ("", ""), "old Trek-520": ("Trek", "old 520")}
    df = spark.createDataFrame([(k,) for k in rows] + [(None,)], "t string")
    got = {r.t: (r["Cleaned Brand"], r["Cleaned Model"]) for r in clean_brand_model(df, "t", d).collect()}
    assert got == {**rows, None: ("", "")}


def test_dictionary_with_many_sections(spark, tmp_path):
    from shoplane.sources import read_brand_dictionary
    path = tmp_path / "many.txt"
    path.write_text("\n\n".join(f"Known S{i} brands:\nMarque {i}" for i in range(1500)))
    rows = read_brand_dictionary(spark, str(path)).collect()
    assert {(r.brand, r.section) for r in rows} == {(f"Marque {i}", f"S{i}") for i in range(1500)}


def test_split_note(spark):
    notes = ["swapped the worn bell\nOrla Finch (6/10/2021 12:03:53)",
             "Tobin Vale (16/12/2021 18:23:10)\nCustomer wants a new basket.\nCheck the mudguard.",
             "Customer brought own saddle.", None]
    df = spark.createDataFrame([(n,) for n in notes], "n string")
    got = [tuple(r.s) for r in df.select(split_note(F.col("n")).alias("s")).collect()]
    assert got[0] == ("swapped the worn bell", "Orla Finch", "6/10/2021 12:03:53")
    assert got[1] == ("Customer wants a new basket.\nCheck the mudguard.", "Tobin Vale", "16/12/2021 18:23:10")
    assert got[2] == ("Customer brought own saddle.", "", "")
    assert got[3] == ("", "", "")
    fb = [tuple(r.s) for r in df.select(note_fallback(F.col("n")).alias("s")).collect()]
    assert fb[1] == ("Customer wants a new basket.\nCheck the mudguard.", "", "")


def test_extract_struct_isolates_failures(spark):
    calls = []

    def extractor(texts):
        calls.append(len(texts))
        out = []
        for x in texts:
            if x == "boom":
                raise RuntimeError("down")
            out.append('{"brand": "B", "model": "%s"}' % x if x != "bad" else "{oops")
        return out

    df = spark.createDataFrame([("a",), ("a",), ("bad",), ("boom",), ("",), (None,)], "t string")
    r = extract_struct(df, "t", BRAND_MODEL, extractor, out="s").collect()
    got = sorted(("<null>" if x.t is None else x.t, x.s.brand, x.s.model) for x in r)
    assert got == sorted([("a", "B", "a"), ("a", "B", "a"), ("bad", "", ""), ("boom", "", ""),
                          ("", "", ""), ("<null>", "", "")])


def test_extractor_partitions_and_outage(spark):
    from pyspark.sql import functions as F
    df = spark.range(2000).select(F.concat(F.lit("t"), F.col("id")).alias("t"))

    def where(texts):
        from pyspark import TaskContext
        return [{"brand": str(TaskContext.get().partitionId()), "model": x} for x in texts]
    r = extract_struct(df, "t", BRAND_MODEL, where, out="s", parallelism=6)
    assert r.select("s.brand").distinct().count() == 6

    def down(texts):
        raise RuntimeError("down")
    with pytest.raises(RuntimeError, match="2000 of 2000"):
        extract_struct(df, "t", BRAND_MODEL, down, out="s")


def test_scratch_is_under_checkpoint_dir(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir().rstrip("/"))
