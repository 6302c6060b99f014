"""Bounded samples for the learned operators: repeated ids, repeated and contradictory labels, clashing names."""

from pyspark.sql import functions as F

from shoplane.llm import html_extract, line_crf, quality_rules
from shoplane.llm.common import bounded_sample
from shoplane.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def test_bounded_sample(spark):
    rows = [(1, "same", 5)] * 400 + [(1, f"text {i}", i) for i in range(50)] + [(i, "x" * i, 0) for i in range(2, 60)] + [(None, "a", 0), (7, None, 0)]
    df = spark.createDataFrame(rows, "id bigint, t string, y int").repartition(6)
    got = bounded_sample(df, "id", "t", 30, 1 << 20).collect()
    assert len(got) == 30 and len({(r.id, r.t) for r in got}) == 30 and all((r.id, r.t) in {(i, t) for i, t, _ in rows} for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, bounded_sample(df.repartition(3), "id", "t", 30, 1 << 20).collect()))
    assert bounded_sample(df, "id", "t", 1000, 1 << 20).count() == len({(i, t) for i, t, _ in rows if i is not None and t is not None})
    few = bounded_sample(df, "id", "t", 1000, 200).collect()
    assert 0 < len(few) and sum(len(r.t) for r in few) <= 200
    assert bounded_sample(df, "id", "t", 5, 0).count() == 1 and bounded_sample(df.limit(0), "id", "t", 5, 9).count() == 0


def test_one_id_on_every_page(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").limit(40).withColumn("page_id", F.lit(1))
    many = pages.crossJoin(spark.range(30).select(F.col("id").alias("copy")))  # 1,200 rows of one id, 40 texts
    got = html_extract._sample(many, 30, 64 << 20, "html", "page_id")
    assert len(got) == 30
    assert html_extract.train_labeller(many, 10, 1, 7) is not None


def test_repeated_and_contradictory_labels(spark, monkeypatch):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("one line here\nand "), (F.col("id") % 90).cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1)] * 20 + [(1, 0)] * 20 + [(2, 0), (2, 1), (None, 1), (1, None)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(line_crf, "train", lambda feats, ys, **kw: seen.append((len(feats), sorted(set(ys)))))
    line_crf.fit(docs, labels, F.lit(True), 50)
    assert seen == [(50, [0, 1])]
    line_crf.fit(docs, labels, F.lit(True), 500)
    assert seen[-1] == (60, [0, 1])  # 30 texts of each of two ids; the third id's labels disagree
    learned = []
    monkeypatch.setattr(quality_rules, "learn_rules", lambda rows: learned.append(rows.count()) or [])
    assert quality_rules.quality_report(docs, labels).count() == 3000
    assert learned[0] < 60


def test_mix_of_a_table_with_the_result_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("*", "1 AS copy_no", "'x' AS shuffle_key", "2 AS rate_source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    same = lambda d: sorted(map(tuple, QUERIES["op10_mix_sources"](spark, d).collect()), key=str)
    assert same(str(tmp_path)) == same(SF_SMALL)


def test_mix_of_repeated_and_null_ids_equals_its_sql(spark, tmp_path):
    import duckdb
    from shoplane.llm.queries import SQL
    rows = [(4, "same text", "b")] * 3 + [(4, "other text", "b"), (None, "no id", "a"), (None, "no id either", "a"), (None, None, None), (5, "", "c"), (6, "x" * 500, "a")]
    rows += [(i, f"text {i}", "ab"[i % 2]) for i in range(10, 60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op10_mix_sources"](spark, str(tmp_path))
    want = db.execute(SQL["op10_mix_sources"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
