"""ML feature stages (M1-M6, E7-E9) as ``pyspark.ml`` Transformers/Estimators.

They persist with ``DefaultParamsWritable`` (fitted state -- vocabulary, idf,
means, modes -- is kept in Params), so a fitted ``PipelineModel`` saves and
loads whole. Transform work is JVM-side: Catalyst expressions or Spark's own
``RegexTokenizer``/``CountVectorizerModel``/``ElementwiseProduct``/
``Normalizer``. Fitting aggregates are partial/final hash aggregates; only
bounded results (100 terms, one mean per column, one mode per column) reach
the driver.
"""

from __future__ import annotations

import logging
import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, Normalizer,
                                RegexTokenizer, StandardScalerModel)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.functions import dates as D
from shoplane.functions import text as X
from shoplane.functions import wordlists as W
from shoplane.operators.schema import col

log = logging.getLogger("shoplane")


class _RW(DefaultParamsReadable, DefaultParamsWritable):
    pass


# ----------------------------------------------------------------- E8

class TextPreprocessor(Transformer, HasInputCol, HasOutputCol, _RW):
    """Lower-case, letters only, tokenize, drop stop words, lemmatise,
    re-join (X6-X11)."""

    stopWords = Param(Params._dummy(), "stopWords", "words to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCol="Repair_Description", outputCol="Processed_Repair_Description",
                 stopWords=None):
        super().__init__()
        self._setDefault(stopWords=list(W.ENGLISH_STOP_WORDS))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(),
                             X.preprocess_text(col(self.getInputCol()), self.getOrDefault("stopWords")))


# ----------------------------------------------------------------- E7

class FeatureEngineer(Transformer, _RW):
    """Calendar features of ``dateCol`` (X12-X14, F8); with ``withLags``
    also lag 1/2 and the 3-row trailing mean of ``valueCol`` in the order
    ``orderCols`` (W1, W2), then backward/forward fill of every column but the
    order's own (W3, W4), all in one ordered pass. ``fillColumns`` names the input and calendar columns to fill instead.

    The lag features use the target itself, so they are off by default for
    training data (they would leak the label)."""

    dateCol = Param(Params._dummy(), "dateCol", "date column", TypeConverters.toString)
    valueCol = Param(Params._dummy(), "valueCol", "value for lags", TypeConverters.toString)
    orderCols = Param(Params._dummy(), "orderCols", "total order", TypeConverters.toListString)
    withLags = Param(Params._dummy(), "withLags", "add lag features", TypeConverters.toBoolean)
    rowsPerBucket = Param(Params._dummy(), "rowsPerBucket", "rows per range bucket", TypeConverters.toInt)
    fillColumns = Param(Params._dummy(), "fillColumns", "columns to fill beside the lags", TypeConverters.toListString)

    @keyword_only
    def __init__(self, dateCol="Date In", valueCol="Repair Duration", orderCols=None,
                 withLags=False, rowsPerBucket=1_000_000, fillColumns=None):
        super().__init__()
        self._setDefault(dateCol="Date In", valueCol="Repair Duration", orderCols=["Date In", "row_id"],
                         withLags=False, rowsPerBucket=1_000_000)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        feats = D.calendar_features(col(self.getOrDefault("dateCol")))
        out = df.select("*", *[c.cast("int").alias(k) for k, c in feats.items()])
        if self.getOrDefault("withLags"):
            from shoplane.operators.ordered import ordered_features
            order = self.getOrDefault("orderCols")
            fills = self.getOrDefault("fillColumns") if self.isDefined("fillColumns") else [c for c in out.columns if c not in order]
            out = ordered_features(out, order, None, index_col=None,
                                   lag_col=self.getOrDefault("valueCol"), lags=(1, 2), rolling=3,
                                   rolling_name="rolling_mean_3", fill_cols=fills, fill_derived=True,
                                   rows_per_bucket=self.getOrDefault("rowsPerBucket"))
        return out


# ----------------------------------------------------------------- E9

class CastToFloat32(Transformer, HasInputCols, _RW):
    """Cast columns to float32."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = set(self.getInputCols())
        return df.select(*[(col(c).cast("float") if c in cols else col(c)).alias(c) for c in df.columns])


def vector_size(df: DataFrame, vec_col: str) -> int | None:
    """Size of a vector column from its ML attribute metadata (no job)."""
    meta = df.schema[vec_col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    attrs = meta.get("attrs", {})
    n = sum(len(v) for v in attrs.values())
    return n or None


def vector_names(df: DataFrame, vec_col: str) -> list[str]:
    """Slot names of a vector column from its ML attribute metadata."""
    attrs = df.schema[vec_col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a.get("name", f"f{a['idx']}")) for v in attrs.values() for a in v)
    return [n for _, n in slots]


class FeatureCounter(Transformer, HasInputCol, _RW):
    """Log the number of features of a vector column (identity)."""

    @keyword_only
    def __init__(self, inputCol="features"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        log.info("assembled vector has %s slots", vector_size(df, self.getInputCol()))
        return df


# ----------------------------------------------------------------- M1

class TfidfTop(Estimator, HasInputCol, HasOutputCol, _RW):
    """M1: TF-IDF over the ``maxFeatures`` most frequent terms (tokens of two
    or more word characters, lower-cased). Vocabulary in alphabetical order,
    frequency ties broken alphabetically; weight tf * (ln((1+n)/(1+df)) + 1),
    rows L2-normalised. Fitting counts hash buckets, the terms of the largest buckets, and the
    documents of the chosen terms (``frequent``): the whole vocabulary is never a table. A column of token arrays (as ``tokens``
    makes them) is taken as it is, so that rows read many times are tokenized once."""

    maxFeatures = Param(Params._dummy(), "maxFeatures", "vocabulary size", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="Processed_Repair_Description", outputCol="tfidf", maxFeatures=100):
        super().__init__()
        self._setDefault(maxFeatures=100)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def tokens(c):
        return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(W.TFIDF_TOKEN_PATTERN), 0)

    @staticmethod
    def tokens_of(df: DataFrame, name: str):
        """The tokens of a column of texts or of token arrays."""
        return col(name) if isinstance(df.schema[name].dataType, T.ArrayType) else TfidfTop.tokens(col(name))

    def _fit(self, df: DataFrame) -> "TfidfTopModel":
        from shoplane.operators.frequent import document_counts, top_terms
        tokens = self.tokens_of(df, self.getInputCol())
        vocab = sorted(w for w, _ in top_terms(df, tokens, self.getOrDefault("maxFeatures")))
        n, held = document_counts(df, tokens, vocab)
        return self.fitted(vocab, n, held)

    def fit_folds(self, df: DataFrame, segment: str, folds: list[int]) -> list["TfidfTopModel"]:
        """The models of all expanding folds (rows of a ``segment`` below each of ``folds``), from the passes of one fit."""
        from shoplane.operators.frequent import fold_document_counts, fold_top_terms
        tokens = self.tokens_of(df, self.getInputCol())
        tops = fold_top_terms(df, tokens, segment, folds, self.getOrDefault("maxFeatures"))
        vocabs = [sorted(w for w, _ in top) for top in tops]
        counts = fold_document_counts(df, tokens, segment, folds, sorted({w for v in vocabs for w in v}))
        return [self.fitted(vocab, n, held) for vocab, (n, held) in zip(vocabs, counts)]

    def fitted(self, vocab: list[str], n: int, held: dict[str, int]) -> "TfidfTopModel":
        """The model of ``vocab``, by the number of documents and of those that hold each term."""
        idf = [math.log((1 + n) / (1 + held[w])) + 1 for w in vocab]
        m = TfidfTopModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                          vocabulary=vocab, idf=idf)
        return self._copyValues(m)


class TfidfTopModel(Model, HasInputCol, HasOutputCol, _RW):
    vocabulary = Param(Params._dummy(), "vocabulary", "terms", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "idf weights", TypeConverters.toListFloat)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "vocabulary size", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, vocabulary=None, idf=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        vocab = self.getOrDefault("vocabulary")
        out = self.getOutputCol()
        tmp_tok, tmp_tf, tmp_w = "_tfidf_tok", "_tfidf_tf", "_tfidf_w"
        if not vocab:
            return df.withColumn(out, array_to_vector(F.array().cast("array<double>")))
        t = df.withColumn(tmp_tok, TfidfTop.tokens_of(df, self.getInputCol()))
        cv = CountVectorizerModel.from_vocabulary(vocab, inputCol=tmp_tok, outputCol=tmp_tf)
        ep = ElementwiseProduct(scalingVec=Vectors.dense(self.getOrDefault("idf")),
                                inputCol=tmp_tf, outputCol=tmp_w)
        nm = Normalizer(p=2.0, inputCol=tmp_w, outputCol=out)
        res = nm.transform(ep.transform(cv.transform(t))).drop(tmp_tok, tmp_tf, tmp_w)
        meta = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": f"tfidf_{w}"}
                                                  for i, w in enumerate(vocab)]},
                            "num_attrs": len(vocab)}}
        return res.withColumn(out, F.col(out).alias(out, metadata=meta))


# ----------------------------------------------------------------- M3

class PopStandardScaler(Estimator, HasInputCol, HasOutputCol, _RW):
    """M3: (x - mean) / population std per vector slot; a zero std divides by
    1. (Spark's StandardScaler uses the sample std.)"""

    @keyword_only
    def __init__(self, inputCol="num_features", outputCol="num_scaled"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "PopStandardScalerModel":
        s = df.select(Summarizer.metrics("mean", "variance", "count").summary(
            col(self.getInputCol())).alias("s")).first()["s"]
        n = s["count"]
        return self.fitted(s["mean"], [v * (n - 1) / n if n else 0.0 for v in s["variance"]])

    def fitted(self, mean, variance) -> "PopStandardScalerModel":
        """The model of the slots' means and population variances."""
        std = [math.sqrt(max(v, 0.0)) for v in variance]
        return PopStandardScalerModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                                      mean=[float(x) for x in mean], std=[x if x > 0 else 1.0 for x in std])


class PopStandardScalerModel(Model, HasInputCol, HasOutputCol, _RW):
    mean = Param(Params._dummy(), "mean", "means", TypeConverters.toListFloat)
    std = Param(Params._dummy(), "std", "population stds (0 -> 1)", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, mean=None, std=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        # Spark's scaler with these numbers: one loop over the slots instead of interpreted array functions
        scaler = StandardScalerModel._create_from_java_class("org.apache.spark.ml.feature.StandardScalerModel", self.uid,
                                                             *[_py2java(df.sparkSession.sparkContext, Vectors.dense(self.getOrDefault(p))) for p in ("std", "mean")])
        scaler._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), withMean=True, withStd=True)
        meta = df.schema[self.getInputCol()].metadata
        return scaler.transform(df.drop(self.getOutputCol())).withMetadata(self.getOutputCol(), meta)


# ----------------------------------------------------------------- M4

NO_MODE = "\u0000no-mode"  # marker for an all-null column

class ModeImputer(Estimator, HasInputCols, HasOutputCols, _RW):
    """M4: fill nulls with the most frequent value (ties -> smallest).
    One grouped count per column; the top row is a TakeOrdered of 1."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        cols = self.getInputCols()
        text = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
        modes = {}
        if text:
            # all text columns in one pass: (column, value) counts, then per
            # column the largest count, smallest value among ties
            pairs = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(text)])
            counts = (df.select(F.inline(pairs)).filter(F.col("v").isNotNull())
                      .groupBy("i", "v").count())
            top = counts.groupBy(F.col("i").alias("ti")).agg(F.max("count").alias("mc"))
            best = (counts.join(top, (F.col("i") == F.col("ti")) & (F.col("count") == F.col("mc")))
                    .groupBy("i").agg(F.min("v").alias("v")).collect())
            for r in best:
                modes[text[r["i"]]] = r["v"]
        for c in cols:
            if c in text:
                continue
            r = (df.filter(col(c).isNotNull()).groupBy(col(c).alias("v")).count()
                 .orderBy(F.desc("count"), F.asc("v")).limit(1).collect())
            modes[c] = str(r[0]["v"]) if r else NO_MODE
        return self.fitted(modes)

    def fitted(self, modes: dict[str, str]) -> "ModeImputerModel":
        """The model of the columns' modes; a column without one is all null."""
        cols = self.getInputCols()
        return ModeImputerModel(inputCols=cols,
                                outputCols=self.getOutputCols() if self.isSet("outputCols") else cols,
                                modes=[modes.get(c, NO_MODE) for c in cols])


class ModeImputerModel(Model, HasInputCols, HasOutputCols, _RW):
    modes = Param(Params._dummy(), "modes", "fill values (as text)", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, modes=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, o, m in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("modes")):
            dt = df.schema[c].dataType
            fill = F.lit(m).cast(dt) if m != NO_MODE else F.lit(None).cast(dt)
            out = out.withColumn(o, F.coalesce(col(c), fill))
        return out
