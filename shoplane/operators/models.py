"""Regression models, time-ordered grid search, scoring, coefficients
(M7-M19, O4, O5, U2).

Models are Spark ML estimators (distributed fits: normal-equation OLS/ridge
aggregates a d x d Gram matrix; L1/elastic net run OWL-QN; trees are
distributed histogram trees). The grid search solves linear models from sums of products
(``gram``); others are a driver loop over (parameter set x fold), each fit a distributed job over a
checkpointed training table. Folds are predicates on a time segment (never shuffled k-fold).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoderModel
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplane.operators.categories import CategoryIndexerModel, named_slots
from shoplane.operators.features import vector_names
from shoplane.operators.folds import FoldFits, FoldPlan, fits_by_moments
from shoplane.operators.gram import MAX_SLOTS, grid_errors, slots_of
from shoplane.operators.joins import union_by_name
from shoplane.operators.metrics import regression_metrics
from shoplane.operators.ordered import time_folds


@dataclass
class ModelSpec:
    """A named model with its hyper-parameter grid. ``build(params, stats)``
    returns the estimator; ``stats`` = {"n", "std_y_pop", "std_y_samp"} of the
    training label, needed to map penalty conventions onto Spark's. A linear model's
    ``penalty(params, n)`` gives (l1, l2) per row for ``gram.solve``: its grid is then searched on sums of products."""
    name: str
    build: Callable[[dict, dict], Estimator]
    grid: list[dict] = field(default_factory=lambda: [{}])
    penalty: Callable[[dict, float], tuple[float, float]] | None = None


def _lr(**kw):
    return LinearRegression(featuresCol="features", labelCol="label", predictionCol="prediction", **kw)


#: Where the normal equations are singular (one-hot slots of a single value), Spark falls back to iterations: until they settle.
_TIGHT = {"tol": 1e-12, "maxIter": 1000}


def _depth(d):
    return 30 if d is None else d  # Spark's maximum depth stands in for "unlimited"


def _grid(**axes) -> list[dict]:
    out = [{}]
    for k, vals in axes.items():
        out = [{**g, k: v} for g in out for v in vals]
    return out


# Penalty alpha maps to Spark's regParam as the survey measured:
# ridge regParam = alpha * std_y / n (population std; the default solver is the
# normal equations up to 4,096 feature slots and l-bfgs beyond, same mapping); lasso
# regParam = alpha; elastic net reg = alpha*rho + alpha*(1-rho)*std_y with
# elasticNetParam = alpha*rho / reg.
REGISTRY: dict[str, ModelSpec] = {
    "Linear Regression": ModelSpec(
        "Linear Regression", lambda p, s: _lr(regParam=0.0, elasticNetParam=0.0, **_TIGHT),
        penalty=lambda p, n: (0.0, 0.0)),
    "Ridge Regression": ModelSpec(
        "Ridge Regression",
        lambda p, s: _lr(regParam=p["alpha"] * s["std_y_pop"] / s["n"], elasticNetParam=0.0,
                         standardization=False, **_TIGHT),
        _grid(alpha=[0.1, 1.0, 10.0, 100.0]), lambda p, n: (0.0, p["alpha"] / n)),
    "Lasso Regression": ModelSpec(
        "Lasso Regression",
        lambda p, s: _lr(regParam=p["alpha"], elasticNetParam=1.0, standardization=False, maxIter=1000),
        _grid(alpha=[0.1, 1.0, 10.0, 100.0]), lambda p, n: (p["alpha"], 0.0)),
    "Elastic Net": ModelSpec(
        "Elastic Net",
        lambda p, s: (lambda reg: _lr(regParam=reg, elasticNetParam=p["alpha"] * p["l1_ratio"] / reg,
                                      standardization=False, maxIter=1000))(
            p["alpha"] * p["l1_ratio"] + p["alpha"] * (1 - p["l1_ratio"]) * s["std_y_pop"]),
        _grid(alpha=[0.1, 1.0, 10.0], l1_ratio=[0.2, 0.5, 0.8]),
        lambda p, n: (p["alpha"] * p["l1_ratio"], p["alpha"] * (1 - p["l1_ratio"]))),
    "Decision Tree": ModelSpec(
        "Decision Tree",
        lambda p, s: DecisionTreeRegressor(featuresCol="features", labelCol="label", seed=42,
                                           maxDepth=_depth(p["max_depth"]),
                                           minInstancesPerNode=max(1, p["min_samples_split"] // 2)),
        _grid(max_depth=[None, 5, 10, 20], min_samples_split=[2, 5, 10])),
    "Random Forest": ModelSpec(
        "Random Forest",
        lambda p, s: RandomForestRegressor(featuresCol="features", labelCol="label", seed=42,
                                           numTrees=p["n_estimators"], maxDepth=_depth(p["max_depth"]),
                                           featureSubsetStrategy="all", bootstrap=p.get("bootstrap", True),
                                           minInstancesPerNode=max(1, p["min_samples_split"] // 2)),
        _grid(n_estimators=[100, 200], max_depth=[None, 10, 20], min_samples_split=[2, 5])),
    "Gradient Boosting": ModelSpec(
        "Gradient Boosting",
        lambda p, s: GBTRegressor(featuresCol="features", labelCol="label", seed=42,
                                  maxIter=p["n_estimators"], stepSize=p["learning_rate"],
                                  maxDepth=p["max_depth"]),
        _grid(n_estimators=[100, 200], learning_rate=[0.01, 0.1, 0.2], max_depth=[3, 5, 10])),
}


def label_stats(df: DataFrame, label: str = "label") -> dict:
    r = df.agg(F.count(F.col(label)).alias("n"), F.stddev_pop(label).alias("p"),
               F.stddev_samp(label).alias("s")).first()
    return {"n": max(1, r["n"]), "std_y_pop": r["p"] or 1.0, "std_y_samp": r["s"] or 1.0}


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch scoring from raw columns (one row or many)."""
    return model.transform(df)


def fold_mae(pred: DataFrame, label: str = "label") -> float:
    return pred.filter(~F.isnan("prediction")).agg(
        F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0]


def _set_up(stages: list) -> tuple:
    """What tells unfitted stages apart: their types and parameters (some defaults hold the stage's own name)."""
    return tuple((type(s).__name__, *sorted((p.name, repr(v).replace(s.uid, "")) for p, v in s.extractParamMap().items())) for s in stages)


def time_series_grid_search(train: DataFrame, n: int, stages: Callable[[Estimator], Pipeline],
                            spec: ModelSpec, n_splits: int = 5, index_col: str = "row_idx",
                            label: str = "label", parallelism: int = 4, segment_col: str | None = None,
                            shared: dict | None = None, together: list[ModelSpec] | None = None) -> tuple[PipelineModel, dict, float, list[dict]]:
    """Every parameter set is fitted on each expanding-window fold's
    training rows and scored by MAE on the fold's test rows; the best mean MAE
    wins and is refitted on all of ``train``. ``train`` carries ``segment_col`` (``ordered.time_segments``) or else
    ``index_col`` (0..n-1 in time order).

    Where the feature stages have nothing to fit, the rows are transformed once; else they are fitted once per fold. Linear models
    of up to ``gram.MAX_SLOTS`` slots get all their fits of a fold from one aggregate of sums of products (``gram``) over the fold's
    vectors as they are made; for the others, which are fitted one by one, the vectors are checkpointed. Linear models over the stages that
    ``folds`` knows are counted for all folds at once there, and those of ``together`` scored in the same pass. ``shared`` keeps what was
    fitted on a fold's rows for further models over the same ``train`` whose feature stages are set up alike."""
    shared = {} if shared is None else shared
    if segment_col is None:
        segment_col, at = "_segment", F.lit(0)
        for start, *_ in time_folds(n, n_splits):
            at = at + (F.col(index_col) >= start).cast("int")
        train = train.withColumn(segment_col, at)
    features = lambda stats: stages(spec.build(spec.grid[0], stats)).getStages()[:-1]
    stateless = all(isinstance(s, Transformer) for s in features({"n": 1, "std_y_pop": 1.0, "std_y_samp": 1.0}))
    penalties = [lambda m, p=p: spec.penalty(p, m) for p in spec.grid]

    def fitted(i):
        """(fitted feature stages, the training label's statistics) of fold i, without one of all rows."""
        rows = train if i is None else train.filter(F.col(segment_col) < i)
        # a penalty is scaled by the rows it is fitted on: each fold has its own statistics
        if (i, label) not in shared:
            shared[i, label] = label_stats(rows, label)
        unfitted = features(shared[i, label])
        key = (i, _set_up(unfitted))
        if key not in shared:
            shared[key] = Pipeline(stages=unfitted).fit(rows)
        return shared[key], shared[i, label]

    def known():
        """The ``FoldFits`` of stages that it can count, for linear models; else None."""
        unfitted = features({"n": 1, "std_y_pop": 1.0, "std_y_samp": 1.0})
        key = ("folds", label, segment_col, n_splits, _set_up(unfitted))
        plan = FoldPlan.of(unfitted, train)
        if plan and key not in shared:
            shared[key] = FoldFits(plan, train, n_splits, label, segment_col)
        return shared[key] if plan and shared[key].width <= MAX_SLOTS else None

    if spec.penalty is not None and not stateless and (found := known()) is not None:
        stats = found.stats[n_splits + 1]
        maes = found.errors(spec, together or [])
        results = [{"params": p, "cv_mae": sum(m[i] for m in maes) / n_splits} for i, p in enumerate(spec.grid)]
        best = min(results, key=lambda r: r["cv_mae"])
        regressor, fitted_stages = spec.build(best["params"], stats), found.stages()
        final = found.fit(regressor) if fits_by_moments(regressor) else regressor.fit(PipelineModel(stages=fitted_stages).transform(train))
        return PipelineModel(stages=[*fitted_stages, final]), best["params"], best["cv_mae"], results

    def solvable(rows):
        return spec.penalty is not None and slots_of(rows) <= MAX_SLOTS

    def fit_each(i, rows, stats):
        tr, te = rows.filter(F.col(segment_col) < i), rows.filter(F.col(segment_col) == i)
        return [fold_mae(spec.build(p, stats).fit(tr).transform(te), label) for p in spec.grid]

    def fold(i):
        model, stats = fitted(i)
        rows = model.transform(train.filter(F.col(segment_col) <= i)).select("features", label, segment_col)
        if solvable(rows):  # this fold's rows only: all of its training segments count as segment 0
            one = rows.withColumn("_fold", (F.col(segment_col) == i).cast("int"))
            return grid_errors(one, penalties, 1, "features", label, "_fold")[0]
        return fit_each(i, rows.checkpoint(eager=True), stats)

    def fold_of_whole(i):
        return fit_each(i, whole, label_stats(whole.filter(F.col(segment_col) < i), label))

    whole = None
    if stateless:
        whole = Pipeline(stages=features({"n": 1, "std_y_pop": 1.0, "std_y_samp": 1.0})).fit(train).transform(train)
        whole = whole.select("features", label, segment_col)
    if whole is not None and solvable(whole):
        maes = grid_errors(whole, penalties, n_splits, "features", label, segment_col)
    else:
        if whole is not None:
            whole = whole.checkpoint(eager=True)
        # independent fits run as concurrent Spark jobs from a small driver pool
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            maes = list(pool.map(fold if whole is None else fold_of_whole, range(1, n_splits + 1)))
    results = [{"params": p, "cv_mae": sum(m[i] for m in maes) / n_splits} for i, p in enumerate(spec.grid)]
    best = min(results, key=lambda r: r["cv_mae"])
    model, stats = fitted(None)
    regressor = spec.build(best["params"], stats).fit(model.transform(train))
    final = PipelineModel(stages=[*model.stages, regressor])
    return final, best["params"], best["cv_mae"], results


def coefficients(model: PipelineModel, scored: DataFrame, features_col: str = "features") -> DataFrame:
    """(feature, coefficient, abs_coefficient) of the linear stage, with names from the assembled vector's ML
    attributes. Slots of a ``CategoryIndexerModel`` get theirs from its dictionary, by a join: the driver has the model's numbers only."""
    lin, spark = model.stages[-1], scored.sparkSession
    coef = lin.coefficients.toArray().tolist()
    names = vector_names(scored, features_col)
    if len(names) != len(coef):
        names = [f"f{i}" for i in range(len(coef))]
    rows = spark.createDataFrame([(i, n, float(c)) for i, (n, c) in enumerate(zip(names, coef))] + [(-1, "intercept", float(lin.intercept))],
                                 "slot long, feature string, coefficient double")
    for indexer in (s for s in model.stages if isinstance(s, CategoryIndexerModel)):
        encoder = next(s for s in model.stages if isinstance(s, OneHotEncoderModel) and set(indexer.getOutputCols()) <= set(s.getInputCols()))
        output = dict(zip(encoder.getInputCols(), encoder.getOutputCols()))
        first = {i: names.index(f"{output[i]}_0") for i, n in zip(indexer.getOutputCols(), indexer.getOrDefault("sizes")) if n and f"{output[i]}_0" in names}
        labels = named_slots(indexer, first, output).withColumnRenamed("feature", "label")
        rows = rows.join(labels, "slot", "left").withColumn("feature", F.coalesce("label", "feature")).drop("label")
    return rows.select("feature", "coefficient", F.abs("coefficient").alias("abs_coefficient"))


def top_coefficients(coef: DataFrame, k: int = 20) -> DataFrame:
    """The k largest coefficients by absolute value (ties by name)."""
    return coef.filter(F.col("feature") != "intercept").orderBy(
        F.desc("abs_coefficient"), F.asc("feature")).limit(k)


def rank_models(metrics: DataFrame, by: str = "mae", ascending: bool = True) -> DataFrame:
    """Order the comparison table by one metric."""
    return metrics.orderBy(F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last())


def compare_models(train: DataFrame, test: DataFrame, n_train: int,
                   stages: Callable[[Estimator], Pipeline], names: list[str],
                   n_splits: int = 5, index_col: str = "row_idx", label: str = "label",
                   registry: dict[str, ModelSpec] | None = None, prefix: list | None = None,
                   parallelism: int = 4, segment_col: str | None = None):
    """M19 + U2: grid-search each named model, score the test rows (NaN
    predictions dropped per model, F6) and collect one metrics row per model."""
    reg = registry or REGISTRY
    rows, models, shared = [], {}, {}
    for name in names:
        spec = reg[name]
        model, params, cv, _ = time_series_grid_search(train, n_train, stages, spec, n_splits,
                                                      index_col, label, parallelism, segment_col, shared, [reg[n] for n in names])
        # scored once: the metrics and the passes of the exact median read the pairs
        pred = model.transform(test).filter(~F.isnan("prediction")).select(label, "prediction").checkpoint(eager=True)
        if prefix:  # the saved model scores raw rows: stateless stages first
            model = PipelineModel(stages=list(prefix) + list(model.stages))
        m = regression_metrics(pred, label, "prediction")
        rows.append(m.select(F.lit(name).alias("model"), F.lit(str(params)).alias("best_params"),
                             F.lit(float(cv)).alias("cv_mae"), "*"))
        models[name] = model
    table = union_by_name(rows)
    return rank_models(table, "mae"), models
