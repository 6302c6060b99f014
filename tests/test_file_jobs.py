"""File-to-file jobs (clean, evaluate, score) on small sheets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoplane.sources import read_table, save_model, write_brand_dictionary, write_sheet


def orders(spark, n=60):
    rows = [((dt.datetime(2022, 3, 1) + dt.timedelta(days=i)).isoformat(" "),
             (dt.datetime(2022, 3, 2) + dt.timedelta(days=i + i % 4)).isoformat(" "),
             f"Greased axle {i % 3}", "ok", ["Trek 520", "Fernway Sparrow"][i % 2], "Bike", "North",
             f"${10 + i % 5}.50") for i in range(n)]
    cols = ["Date In", "Date", "Description", "Cleaned Work Order Internal Note", "Brand and model", "Type", "Shop", "Total_y"]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_evaluate_and_score_files(spark, tmp_path):
    from shoplane.operators.models import REGISTRY
    from shoplane.plans.workflow import evaluate_files, full_stages, prepare_training, score_files
    write_sheet(orders(spark), f"{tmp_path}/sheet")
    model = full_stages(REGISTRY["Linear Regression"].build({}, {}), max_features=5).fit(prepare_training(orders(spark)))
    save_model(model, f"{tmp_path}/model")
    evaluate_files(spark, f"{tmp_path}/model", f"{tmp_path}/sheet", f"{tmp_path}/out", bins=10)
    scores = read_table(spark, f"{tmp_path}/out/scores")
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/out/{name}")
    assert scores.count() == 60
    want = scores.select(F.avg(F.abs(F.col("actual") - F.col("prediction")))).first()[0]
    metrics = read("metrics").first()
    assert int(metrics.n) == 60 and abs(float(metrics.mae) - want) < 1e-9
    assert sum(int(r["count"]) for r in read("residual_histogram").collect()) == 60
    assert sum(int(r["count"]) for r in read("actual_by_predicted").collect()) == 60
    assert read("residual_density").count() == 200 and read("top_coefficients").count() > 0
    score_files(spark, f"{tmp_path}/model", f"{tmp_path}/sheet", f"{tmp_path}/scored")
    scored = read_table(spark, f"{tmp_path}/scored")
    assert scored.columns == [*orders(spark).columns, "prediction"] and scored.where("prediction is null").count() == 0


def test_clean_files(spark, tmp_path):
    from shoplane.plans.workflow import clean_work_order_files
    rows = [("Zoë Marlow (18/12/2021 18:16:23) tuned", "ebk Trek 520"), ("no stamp", "Trek 1"), (None, "Trek 2")]
    write_sheet(spark.createDataFrame(rows, "note string, bike string"), f"{tmp_path}/sheet")
    write_brand_dictionary(spark.createDataFrame([("Trek", "Bicycle")], "brand string, section string"), f"{tmp_path}/brands")
    clean_work_order_files(spark, f"{tmp_path}/sheet", f"{tmp_path}/brands", f"{tmp_path}/out", note_col="note", brand_col="bike")
    got = [(r["Cleaned Brand"], r["Cleaned Model"]) for r in read_table(spark, f"{tmp_path}/out").collect()]
    assert got == [("Trek", "520")]


def test_noun_lemmas(spark):
    from shoplane.functions.text import lemmatize_nouns
    words = {"cases": "case", "hoses": "hose", "series": "series", "lens": "lens", "lenses": "lens", "gas": "gas", "knives": "knife",
             "specimen": "specimen", "women": "woman", "glasses": "glass", "brushes": "brush", "boxes": "box", "batteries": "battery",
             "valves": "valve", "sleeves": "sleeve", "brakes": "brake", "chassis": "chassis", "bus": "bus", "glass": "glass"}
    df = spark.createDataFrame([(list(words),)], "w array<string>")
    assert df.select(lemmatize_nouns("w")).first()[0] == list(words.values())


def test_a_model_of_other_categories_scores_without_the_default_ones(spark):
    import datetime as dt
    from dataclasses import replace
    from shoplane.operators.models import REGISTRY
    from shoplane.plans.workflow import score_records, train_duration_models
    day = dt.datetime(2021, 3, 1)
    rows = [(i, day + dt.timedelta(days=i % 50), day + dt.timedelta(days=i % 50 + (3 if i % 2 else 9) + i % 3), ["Zap", "Volt"][i % 2], "Brake fixed", None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, `Date In` timestamp_ntz, Date timestamp_ntz, `Cleaned Brand` string, Description string, `Cleaned Work Order Internal Note` string")
    registry = {"Ridge": replace(REGISTRY["Ridge Regression"], grid=[{"alpha": 0.1}])}
    table, models = train_duration_models(df, ["Date In", "id"], models=["Ridge"], registry=registry, n_splits=2, max_features=3, categorical=["Cleaned Brand"])
    assert table.count() == 1
    record = {"Date In": "2021-04-02 10:00:00", "Cleaned Brand": "Volt", "Description": "Brake fixed"}
    schema = "`Date In` string, `Cleaned Brand` string, Description string, `Cleaned Work Order Internal Note` string"
    volt, zap = (score_records(spark, models["Ridge"], {**record, "Cleaned Brand": b}, schema).first().prediction for b in ("Volt", "Zap"))
    assert 3 <= volt < 6 < 8 < zap <= 12
    with pytest.raises(Exception, match="Cleaned Brand"):
        score_records(spark, models["Ridge"], {"Date In": "2021-04-02"}, "`Date In` string, Description string, `Cleaned Work Order Internal Note` string")


def test_merge_options(spark):
    from shoplane.plans.workflow import merge_sheets
    lines = spark.createDataFrame([("1", "16/12/2021 18:23:10"), (None, "3/4/2021 00:00:00")], "`WO#` string, Date string")
    orders = spark.createDataFrame([("1", "a"), (None, "b")], "ID string, x string")
    got = merge_sheets(lines, orders).collect()
    assert [(r.x, str(r.Date)) for r in got] == [("a", "2021-12-16 18:23:10")]  # no 16th month: the other order
    both = {(r.x, str(r.Date)) for r in merge_sheets(lines, orders, null_safe=True, day_first=True).collect()}
    assert both == {("a", "2021-12-16 18:23:10"), ("b", "2021-04-03 00:00:00")}
    assert {str(r.Date) for r in merge_sheets(lines, orders, null_safe=True).collect()} == {"2021-12-16 18:23:10", "2021-03-04 00:00:00"}


@pytest.mark.parametrize("multi_line", [True, False])
def test_sheets_of_other_column_orders(spark, tmp_path, multi_line):
    from shoplane.sources import read_sheet
    write_sheet(spark.createDataFrame([("1", "x, y")], "`WO#` string, note string"), f"{tmp_path}/a")
    write_sheet(spark.createDataFrame([("say \"hi\"", "2", "new")], "note string, `WO#` string, extra string"), f"{tmp_path}/b")
    write_sheet(spark.createDataFrame([("3", "z")], "`WO#` string, note string"), f"{tmp_path}/c")
    got = read_sheet(spark, [f"{tmp_path}/{x}" for x in "abc"], multi_line=multi_line)
    assert got.columns == ["WO#", "note", "extra"]
    assert sorted(map(tuple, got.collect())) == [("1", "x, y", None), ("2", 'say "hi"', "new"), ("3", "z", None)]
