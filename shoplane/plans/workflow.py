"""End-to-end batch jobs: merge -> clean -> train -> evaluate -> score
(SURVEY §3). Each is one lazy plan per step; paths are arguments.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplane.functions import coerce as C
from shoplane.functions.dates import repair_duration
from shoplane.operators import filters as FL
from shoplane.operators import schema as S
from shoplane.operators.brands import clean_brand_model
from shoplane.operators.categories import CategoryIndexer
from shoplane.operators.features import (FeatureCounter, FeatureEngineer, ModeImputer, ModeImputerModel,
                                         PopStandardScaler, TextPreprocessor, TfidfTop)
from shoplane.operators.joins import merge_on
from shoplane.operators.metrics import density_curve, regression_metrics, residual_histogram, scatter_bins
from shoplane.operators.models import (REGISTRY, coefficients, compare_models, top_coefficients)
from shoplane.operators.notes import split_note_columns
from shoplane.operators.ordered import time_segments, time_split
from shoplane.session import ensure_checkpoint_dir, scratch_path
from shoplane.sources import read_table, write_table

# FIXED VALUES -- feature columns.
NUMERIC = ["Year", "Month", "WeekOfYear", "DayOfWeek", "Quarter", "IsWeekend"]
CATEGORICAL = ["Brand and model", "Type", "Shop"]


# --------------------------------------------------------------- 3.1 merge

def merge_sheets(lines: DataFrame, orders: DataFrame, left_on: str = "WO#", right_on: str = "ID",
                 dates=("Date In", "Due On", "Date"), quantities=("Qty",), dollars=(), null_safe: bool = False,
                 date_formats: list[str] | None = None, day_first: bool = False) -> DataFrame:
    """Lines joined to their work orders (J1), then typed (P10). By default a line without a number meets no order;
    ``null_safe`` matches it to every order without one, as a dataframe merge does."""
    merged = merge_on(lines, orders, left_on, right_on, null_safe=null_safe)
    return S.coerce_types(merged, dates=[c for c in dates if c in merged.columns],
                          quantities=quantities, dollars=dollars, date_formats=date_formats, day_first=day_first)


def merge_sheet_files(spark: SparkSession, lines_path: str, orders_path: str, out_path: str, **options) -> None:
    """Two exported sheets -> merged table (``options`` as in ``merge_sheets``)."""
    from shoplane.sources import read_sheet, write_table
    merged = merge_sheets(read_sheet(spark, lines_path), read_sheet(spark, orders_path), **options)
    write_table(merged, out_path)


# --------------------------------------------------------------- 3.2 clean

def clean_work_orders(df: DataFrame, dictionary: DataFrame,
                      note_col: str = "Work Order Internal Note",
                      brand_col: str = "Brand and model ", split_notes: bool = False,
                      faithful: bool = False) -> DataFrame:
    """Usable notes only (F1), required columns (P2), brand/model resolved
    (E2, ``faithful`` as there); with ``split_notes`` also the note split (E3)."""
    S.require_columns(df, [note_col, brand_col], error=ValueError)
    out = FL.usable_notes(df, note_col)
    out = clean_brand_model(out, brand_col, dictionary, faithful=faithful)
    if split_notes:
        out = split_note_columns(out, note_col)
    return out


def clean_work_order_files(spark: SparkSession, in_path: str, dictionary_path: str, out_path: str, **options) -> None:
    """Sheet and dictionary files -> cleaned table (``options`` as in ``clean_work_orders``)."""
    from shoplane.sources import read_brand_dictionary, read_sheet, write_table
    cleaned = clean_work_orders(read_sheet(spark, in_path), read_brand_dictionary(spark, dictionary_path), **options)
    write_table(cleaned, out_path)


# --------------------------------------------------------------- 3.3 train

def prepare_training(df: DataFrame, outlier_threshold: float = 3.0, categorical=CATEGORICAL,
                     label: str = "label") -> DataFrame:
    """P1, P3, P5, X15/X16, F2, F3, P4, P14 -> training rows with ``label``."""
    df = S.trim_column_names(df)
    df = S.build_text(df, "Repair_Description", "Description", "Cleaned Work Order Internal Note")
    for c in ("Date In", "Date"):
        df = df.withColumn(c, C.to_ts(S.col(c), strict=True, dtype=df.schema[c].dataType))
    df = df.withColumn("Repair Duration", repair_duration(S.col("Date In"), S.col("Date")))
    df = FL.drop_nulls(df, ["Repair Duration"])
    df = FL.remove_outliers(df, "Repair Duration", outlier_threshold)
    df = S.fill_unknown(df, [c for c in categorical if c in df.columns])
    return df.withColumn(label, S.col("Repair Duration").cast("float").cast("double"))


def raw_stages() -> list:
    """Stateless stages from raw columns: text prep (E8), calendar.
    Hoisted out of the cross-validation loop (computed once, then
    checkpointed) and prepended to every fitted model so it scores raw rows."""
    return [TextPreprocessor(inputCol="Repair_Description", outputCol="Processed_Repair_Description"),
            FeatureEngineer(dateCol="Date In")]


def duration_stages(regressor, max_features: int = 100, numeric=NUMERIC,
                    categorical=CATEGORICAL) -> Pipeline:
    """M7: TF-IDF (M1) -> mean impute (M2) -> assemble -> population scaling
    (M3) -> mode impute (M4) -> one-hot, unseen = zeros (M5) -> assemble (M6)
    -> count (E9) -> regressor. Input: rows after ``raw_stages``."""
    imp = [f"{c}__imp" for c in numeric]
    filled = [f"{c}__filled" for c in categorical]
    idx = [f"{c}__idx" for c in categorical]
    ohe = [f"{c}__ohe" for c in categorical]
    return Pipeline(stages=[
        TfidfTop(inputCol="Processed_Repair_Description", outputCol="tfidf", maxFeatures=max_features),
        Imputer(strategy="mean", inputCols=list(numeric), outputCols=imp),
        VectorAssembler(inputCols=imp + ["tfidf"], outputCol="num_features", handleInvalid="keep"),
        PopStandardScaler(inputCol="num_features", outputCol="num_scaled"),
        ModeImputer(inputCols=list(categorical), outputCols=filled),
        CategoryIndexer(inputCols=filled, outputCols=idx),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="error"),
        VectorAssembler(inputCols=["num_scaled"] + ohe, outputCol="features"),
        FeatureCounter(inputCol="features"),
        regressor,
    ])


def full_stages(regressor, max_features: int = 100) -> Pipeline:
    """Raw columns -> prediction in one Pipeline (for direct fitting)."""
    return Pipeline(stages=raw_stages() + duration_stages(regressor, max_features).getStages())


def train_duration_models(df: DataFrame, order: list[str], models=("Linear Regression",),
                          ratio: float = 0.9, n_splits: int = 5, max_features: int = 100,
                          registry=None, parallelism: int = 4, categorical=CATEGORICAL):
    """3.3: prepare, hold out the last 10% in time order (O2),
    grid-search each model on expanding folds (O3, M16), score the hold-out, and
    return (metrics table ranked by MAE, fitted raw-column models). Split and folds are
    predicates on the order columns; no row is numbered."""
    prefix = raw_stages()
    rows = PipelineModel(stages=prefix).transform(prepare_training(df, categorical=categorical))
    # the models read these columns only: raw notes are not stored. Every fit reads the table again, most of them few of its
    # columns, so it is Parquet on the shared folder, with the texts as tokens
    text = "Processed_Repair_Description"
    rows = rows.select(*[TfidfTop.tokens_of(rows, c).alias(c) if c == text else S.col(c) for c in dict.fromkeys([*order, text, *NUMERIC, *categorical, "label"])])
    path = scratch_path(df.sparkSession, "training")
    write_table(rows, path)
    rows = read_table(df.sparkSession, path)
    train, test = time_split(rows, order, ratio)
    train, n_train = time_segments(train, order, n_splits, "_segment")
    path = scratch_path(df.sparkSession, "segments")
    registry = registry or REGISTRY
    # linear models are counted for all folds in one pass; where others are fitted fold by fold, a fold reads its own segments
    write_table(train, path, partition_by=[] if all(registry[m].penalty is not None for m in models) else ["_segment"])
    train = read_table(df.sparkSession, path)

    def stages(est):
        return duration_stages(est, max_features, categorical=categorical)
    return compare_models(train, test, n_train, stages, list(models), n_splits, label="label",
                          registry=registry, prefix=prefix, parallelism=parallelism, segment_col="_segment")


# ------------------------------------------------------------ 3.4 evaluate

# FIXED VALUES -- money columns.
MONEY = ["Labor", "Parts", "Subtotal", "Total_y"]


def prepare_evaluation(df: DataFrame, money=MONEY, total: str = "Total_y", outlier_threshold: float = 3.0,
                       date_in: str = "Date In", date_out: str = "Date",
                       duration: str = "Repair Duration", date_formats: list[str] | None = None, day_first: bool = False,
                       counts: dict[str, int] | None = None) -> DataFrame:
    """Rows to score: dates parsed (P6), money text to numbers (X5), duration
    (X15/X16), rows without duration or ``total`` dropped (F2), outliers of the
    duration and then, among the survivors, of ``total`` removed (F3 twice).
    A ``total`` that isn't a number counts as missing.

    The typed rows are checkpointed: both outlier steps take their statistics from there, one aggregate each, and parse nothing
    again. ``counts`` gets the rows that enter each outlier step, by its column (F4)."""
    df = S.trim_column_names(df)
    S.require_columns(df, [date_in, date_out, total])
    for c in (date_in, date_out):
        df = df.withColumn(c, C.to_ts(S.col(c), strict=False, formats=date_formats, dtype=df.schema[c].dataType, day_first=day_first))
    for c in money:
        if c in df.columns:
            df = df.withColumn(c, C.money_to_double(S.col(c)))
    df = df.withColumn(duration, repair_duration(S.col(date_in), S.col(date_out)))
    ensure_checkpoint_dir(df.sparkSession)
    df = FL.drop_nulls(df, [duration, total]).checkpoint(eager=True)
    for c in (duration, total):
        n, stats = FL.value_stats(df, c)
        if counts is not None:
            counts[c] = n
        df = FL.remove_outliers(df, c, outlier_threshold, stats=stats)
    return df


def evaluate_model(model: PipelineModel, df: DataFrame, top_k: int = 20, bins: int = 50,
                   label: str = "label"):
    """Scores (M17), metrics (A10), residual histogram (A11), top-k
    coefficients (M18, O4)."""
    scored = model.transform(df).filter(~F.isnan("prediction"))
    pairs = scored.select(S.col(label).alias(label), "prediction").checkpoint(eager=True)  # scored once
    metrics = regression_metrics(pairs, label, "prediction")
    resid = pairs.select((F.col(label) - F.col("prediction")).alias("residual"))
    hist = residual_histogram(resid, "residual", bins)
    coefs = top_coefficients(coefficients(model, scored), top_k)
    return metrics, hist, coefs


def evaluation_tables(scored: DataFrame, label: str = "label", bins: int = 50) -> dict[str, DataFrame]:
    """Metrics (A10), residual histogram (A11) and density (A12), and the 2-D
    bins of actual and residual against predicted (A14) of scored rows."""
    pairs = FL.drop_nan(scored, [label, "prediction"]).select(
        S.col(label).alias("actual"), "prediction", (S.col(label) - F.col("prediction")).alias("residual"))
    return {"metrics": regression_metrics(pairs, "actual", "prediction"),
            "residual_histogram": residual_histogram(pairs, "residual", bins),
            "residual_density": density_curve(pairs, "residual"),
            "actual_by_predicted": scatter_bins(pairs, "prediction", "actual", bins),
            "residual_by_predicted": scatter_bins(pairs, "prediction", "residual", bins)}


def evaluate_files(spark: SparkSession, model_path: str, in_path: str, out_path: str, top_k: int = 20,
                   bins: int = 50, label: str = "Repair Duration", **options) -> None:
    """Sheet of finished work orders -> prepared rows scored by a saved model;
    the scores (Parquet) and each evaluation table (CSV) under ``out_path`` (``options`` as in ``prepare_evaluation``)."""
    from shoplane.sources import load_model, read_sheet, read_table, write_csv, write_table
    rows = prepare_evaluation(read_sheet(spark, in_path), **options)
    rows = S.build_text(rows, "Repair_Description", "Description", "Cleaned Work Order Internal Note")
    model = load_model(model_path)
    rows = S.fill_unknown(rows, [c for c in _categories(model) if c in rows.columns])
    scored = model.transform(rows)
    write_table(scored.select(S.col(label).cast("double").alias("actual"), "prediction"), f"{out_path}/scores")
    scores = read_table(spark, f"{out_path}/scores")  # scored once, read by every table
    for name, table in evaluation_tables(scores, "actual", bins).items():
        write_csv(table, f"{out_path}/{name}")
    if hasattr(model.stages[-1], "coefficients"):
        write_csv(top_coefficients(coefficients(model, scored), top_k), f"{out_path}/top_coefficients")


def score_files(spark: SparkSession, model_path: str, in_path: str, out_path: str) -> None:
    """Sheet of new work orders -> its columns and the saved model's ``prediction``."""
    from shoplane.sources import load_model, read_sheet, write_table
    rows = read_sheet(spark, in_path)
    write_table(_score(load_model(model_path), rows).select(*[S.col(c) for c in rows.columns], "prediction"), out_path)


def _categories(model: PipelineModel) -> list[str]:
    """The category columns that the model was trained on."""
    return [c for s in model.stages if isinstance(s, ModeImputerModel) for c in s.getInputCols()]


def _score(model: PipelineModel, df: DataFrame) -> DataFrame:
    S.require_columns(df, ["Date In", "Description", "Cleaned Work Order Internal Note", *_categories(model)])
    df = S.build_text(df, "Repair_Description", "Description", "Cleaned Work Order Internal Note")
    df = df.withColumn("Date In", C.to_ts(S.col("Date In"), strict=True, dtype=df.schema["Date In"].dataType))
    return model.transform(df)


def score_records(spark: SparkSession, model: PipelineModel, records, schema) -> DataFrame:
    """predict: records (dicts) -> one-row/many-row frame (S4) -> scores."""
    from shoplane.sources import records_to_df
    return _score(model, records_to_df(spark, records, schema))
