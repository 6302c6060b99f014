"""Lemmas that a lexicon confirms; the density curve against the direct sum."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplane.operators import metrics as M
from shoplane.operators.lemmas import exceptions_frame, lemma_table, lemmatize_rows, preprocess_with_lexicon

GOLDEN = {"brakes": "brake", "batteries": "battery", "boxes": "box", "buses": "bus", "axes": "axis", "glasses": "glass", "wolves": "wolf", "men": "man",
          "firemen": "fireman", "churches": "church", "wishes": "wish", "quizzes": "quizzes", "bus": "bus", "gas": "gas", "tires": "tire", "xyzs": "xyzs",
          "s": "s", "brake": "brake", "dresses": "dress", "halves": "half", "ñs": "ñ"}
LEXICON = ["brake", "battery", "box", "glass", "wolf", "man", "fireman", "church", "wish", "bus", "tire", "dress", "half", "axe", "ñ", "ga", None, "brake"]


def test_golden_words(spark):
    words = spark.createDataFrame([(w,) for w in [*GOLDEN, None, "brakes"]], "word string")
    lexicon = spark.createDataFrame([(w,) for w in LEXICON], "lemma string")
    for limit in (1 << 20, 0):
        table = {r.word: r.lemma for r in lemma_table(words, lexicon, exceptions_frame(spark), broadcast_bytes=limit).collect()}
        assert {w: table.get(w, w) for w in GOLDEN} == GOLDEN
        assert all(w != lemma for w, lemma in table.items())


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_rows_keep_their_words_in_place(spark, limit):
    rows = [(1, ["brakes", "x", "brakes", "men"], "a"), (2, [], "b"), (3, None, "c"), (4, ["x", None, "boxes"], None)]
    df = spark.createDataFrame(rows, "id int, t array<string>, lemma string").repartition(3)
    table = lemma_table(df.select(F.explode("t").alias("word")), spark.createDataFrame([("brake",), ("box",)], "lemma string"), exceptions_frame(spark))
    got = {r.id: (r.t, r.lemma) for r in lemmatize_rows(df, "t", table, "id", limit).collect()}
    assert got == {1: (["brake", "x", "brake", "man"], "a"), 2: ([], "b"), 3: (None, "c"), 4: (["x", None, "box"], None)}
    text = spark.createDataFrame([(1, "The brakes, and 2 boxes"), (2, None)], "id int, text string")
    out = preprocess_with_lexicon(text, "text", "p", "id", spark.createDataFrame([("brake",)], "lemma string"), plan_bytes=limit)
    assert {r.id: r.p for r in out.collect()} == {1: "brake boxes", 2: ""}


@pytest.mark.parametrize("seed", range(3))
def test_density_is_the_direct_sum(spark, seed):
    rng = np.random.default_rng(seed)
    x = [rng.normal(3, 2, 3000), np.concatenate([rng.exponential(1, 2000), [500.0, -80.0]]), np.concatenate([rng.normal(size=500) * 1e-2 + 50, np.full(700, 50.0)])][seed]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "v double").repartition(4)
    for points in (200, 7):
        got = M.density_curve(df, "v", points).orderBy("x").toPandas()
        bw = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, points)
        want = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
        np.testing.assert_allclose(got["x"], grid, rtol=1e-12)
        np.testing.assert_allclose(got["density"], want, rtol=1e-9, atol=1e-9 * want.max())
    assert M.density_curve(df.limit(0), "v").count() == 0
    assert M.density_curve(spark.createDataFrame([(2.0,)] * 3, "v double"), "v").count() == 0
