"""Text, number and category features of all expanding folds at once.

Fold i trains on the time segments below i, so whatever adds up over segments is counted once for all folds: label statistics, column
means, category counts, term counts. One pass then sums the products of the unscaled features, per segment where a row looks the same in every
fold, per fold where it does not (its text: vocabulary and weights are the fold's; its nulls: the fill values are). Means and deviations of
``PopStandardScaler`` come from these sums, and scaling turns them into those of the scaled features, on the driver. A second pass scores all
linear fits. Rows reach the tasks as numbers, category codes and the counts of the few terms they hold, never as assembled vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, Imputer, OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.operators.categories import CategoryIndexer
from shoplane.operators.features import FeatureCounter, ModeImputer, PopStandardScaler, TfidfTop
from shoplane.operators.gram import _CELLS, MAX_SLOTS, Moments, solve
from shoplane.operators.schema import col

_KINDS = (TfidfTop, Imputer, VectorAssembler, PopStandardScaler, ModeImputer, CategoryIndexer, OneHotEncoder, VectorAssembler, FeatureCounter)


@dataclass
class FoldPlan:
    """The stages of a pipeline of these features, in order."""

    tfidf: TfidfTop
    imputer: Imputer
    numbers: VectorAssembler
    scaler: PopStandardScaler
    modes: ModeImputer
    indexer: CategoryIndexer
    encoder: OneHotEncoder
    assembler: VectorAssembler
    counter: FeatureCounter

    @classmethod
    def of(cls, stages: list, df: DataFrame) -> "FoldPlan | None":
        """The plan of unfitted ``stages`` over ``df``, or None where they are others than those counted here."""
        if tuple(map(type, stages)) != _KINDS:
            return None
        p = cls(*stages)
        types = {f.name: f.dataType for f in df.schema}
        nums, cats = p.imputer.getInputCols(), p.modes.getInputCols()
        filled = p.modes.getOutputCols() if p.modes.isSet("outputCols") else cats
        wired = (p.numbers.getInputCols() == [*p.imputer.getOutputCols(), p.tfidf.getOutputCol()] and p.scaler.getInputCol() == p.numbers.getOutputCol()
                 and p.indexer.getInputCols() == filled and p.encoder.getInputCols() == p.indexer.getOutputCols() and p.encoder.getDropLast()
                 and p.assembler.getInputCols() == [p.scaler.getOutputCol(), *p.encoder.getOutputCols()] and p.counter.getInputCol() == p.assembler.getOutputCol() == "features"
                 and p.imputer.getStrategy() == "mean" and math.isnan(p.imputer.getMissingValue()) and set(nums).isdisjoint(cats))
        plain = all(isinstance(types.get(c), (T.IntegralType, T.FloatType, T.DoubleType)) for c in nums) and all(isinstance(types.get(c), T.StringType) for c in cats)
        return p if wired and plain else None


@dataclass
class _Layout:
    """Places in the sums: 1, the numbers, the terms of any fold, the codes of each category column, the label."""

    numbers: int
    terms: int
    sizes: list[int]

    @property
    def width(self) -> int:  # of the dense block: 1, numbers, terms, label
        return self.numbers + self.terms + 2

    @property
    def first(self) -> list[int]:
        return (1 + self.numbers + self.terms + np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)).tolist()

    @property
    def total(self) -> int:
        return self.width + sum(self.sizes)

    def place(self) -> np.ndarray:
        """Of the dense block's columns among all."""
        return np.append(np.arange(self.width - 1), self.total - 1)


class _Sums:
    """Sums of products of a dense block and category codes (below 0: none), with the extremes of the dense columns."""

    def __init__(self, at: _Layout):
        w, n = at.width, at.sizes
        self.at, self.dd, self.cd = at, np.zeros((w, w)), [np.zeros((k, w)) for k in n]
        self.cc = {(a, b): np.zeros((n[a], n[b])) for a in range(len(n)) for b in range(a + 1, len(n))}
        self.lo, self.hi = np.full(w, np.inf), np.full(w, -np.inf)

    def add(self, cols: np.ndarray, d: np.ndarray, codes: list[np.ndarray]) -> None:
        self.dd[np.ix_(cols, cols)] += d.T @ d
        self.lo[cols], self.hi[cols] = np.minimum(self.lo[cols], d.min(axis=0)), np.maximum(self.hi[cols], d.max(axis=0))
        for a, code in enumerate(codes):
            if not self.at.sizes[a]:
                continue
            seen = code >= 0
            every = bool(seen.all())
            ca, da = (code, d) if every else (code[seen], d[seen])
            if not len(ca):
                continue
            if len(cols) <= 16:
                for k, j in enumerate(cols):
                    self.cd[a][:, j] += np.bincount(ca, weights=da[:, k], minlength=self.at.sizes[a])
            else:
                order = np.argsort(ca, kind="stable")
                held, start = np.unique(ca[order], return_index=True)
                self.cd[a][np.ix_(held, cols)] += np.add.reduceat(da[order], start, axis=0)
            for b in range(a + 1, len(codes)):
                both = seen & (codes[b] >= 0)
                pair = code[both].astype(np.int64) * self.at.sizes[b] + codes[b][both]
                if len(pair):
                    self.cc[a, b] += np.bincount(pair, minlength=self.cc[a, b].size).reshape(self.cc[a, b].shape)

    def cells(self):
        """(i, j, value) of the upper triangle's cells that are not 0; rows -1 and -2 are the least and the largest values."""
        at, place = self.at, self.at.place()
        out = np.zeros((at.total, at.total))
        out[np.ix_(place, place)] = self.dd
        for a, k in enumerate(at.first[:-1]):
            here = np.arange(k, k + at.sizes[a])
            out[np.ix_(here, place)], out[np.ix_(place, here)] = self.cd[a], self.cd[a].T
            out[here, here] = self.cd[a][:, 0]
            for b in range(a + 1, len(at.sizes)):
                out[k:k + at.sizes[a], at.first[b]:at.first[b] + at.sizes[b]] = self.cc[a, b]
        i, j = np.nonzero(np.triu(out))
        v = out[i, j]
        met = np.flatnonzero(np.isfinite(self.lo))
        return (np.concatenate([i, np.full(len(met), -1), np.full(len(met), -2)]).astype(np.int32), np.concatenate([j, place[met], place[met]]).astype(np.int32),
                np.concatenate([v, self.lo[met], self.hi[met]]))


class _Fold:
    """What a task needs to make a fold's features: fill values, weights of the terms (0: not in the vocabulary)."""

    def __init__(self, fill: np.ndarray, modes: list[int], weights: np.ndarray):
        self.fill, self.modes, self.weights = fill, modes, weights

    def block(self, rows: "_Rows", at: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(1, numbers, terms, label) and the codes of the rows ``at``; numbers and label less ``shift``."""
        n, p, u = len(at), rows.x.shape[1], len(self.weights)
        d = np.zeros((n, p + u + 2))
        d[:, 0] = 1
        x = rows.x[at]
        d[:, 1:p + 1] = np.where(np.isnan(x), self.fill, x) - shift[:-1]
        d[:, -1] = rows.y[at] - shift[-1]
        if u:
            lens = rows.lens[at]
            row = np.repeat(np.arange(n), lens)
            flat = np.repeat(rows.starts[at] - np.cumsum(lens) + lens, lens) + np.arange(len(row))
            v = rows.tf[flat] * self.weights[rows.terms[flat]]
            norm = np.sqrt(np.bincount(row, weights=v * v, minlength=n))
            norm[norm == 0] = 1
            d[row, 1 + p + rows.terms[flat]] = v / norm[row]
        return d, [np.where(c[at] < 0, m, c[at]) for c, m in zip(rows.codes, self.modes)]


class _Rows:
    """A batch's columns as arrays; a null code is -1. ``varied``: rows that differ from fold to fold."""

    def __init__(self, batch: pa.RecordBatch, at: _Layout):
        array = lambda c: c.to_numpy(zero_copy_only=False)
        p, k = at.numbers, len(at.sizes)
        self.s, self.y = array(batch.column(0)), array(batch.column(1))
        self.x = np.column_stack([array(batch.column(2 + i)) for i in range(p)]) if p else np.zeros((len(self.s), 0))
        self.codes = [np.where((c := array(batch.column(2 + p + i))) == n, -1, c).astype(np.int64) for i, n in enumerate(at.sizes)]
        lists, tf = batch.column(2 + p + k), batch.column(3 + p + k)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        self.starts, self.lens = offsets[:-1] - offsets[0], np.diff(offsets)
        self.terms, self.tf = np.asarray(lists.flatten()), np.asarray(tf.flatten())
        self.varied = (self.lens > 0) | np.isnan(self.x).any(axis=1)
        for c in self.codes:
            self.varied |= c < 0


class FoldFits:
    """Everything fitted on the folds of ``train``: folds 1..n_splits and, as fold n_splits + 1, all rows."""

    def __init__(self, plan: FoldPlan, train: DataFrame, n_splits: int, label: str, segment: str):
        self.plan, self.n_splits, self.label, self.segment = plan, n_splits, label, segment
        self.folds = list(range(1, n_splits + 2))
        self.train = train.where(F.col(segment).isNotNull())
        self._errors: list[tuple] = []
        self._count_columns()
        if self.width <= MAX_SLOTS:
            self._count_terms()
            self._sum_products()

    # ------------------------------------------------------------ fitted state by fold

    def _count_columns(self) -> None:
        plan, nums, cats, s = self.plan, self.plan.imputer.getInputCols(), self.plan.modes.getInputCols(), F.col(self.segment)
        number = lambda c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double"))
        y = col(self.label).cast("double")
        rows = self.train.groupBy(s.alias("s")).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"),
                                                    *[f for i, c in enumerate(nums) for f in (F.count(number(c)).alias(f"n{i}"), F.sum(number(c)).alias(f"t{i}"))]).collect()
        self.stats, means = {}, {}
        for f in self.folds:
            here = [r for r in rows if r["s"] < f]
            n = sum(r["n"] for r in here)
            m = sum(r["n"] * r["m"] for r in here if r["n"]) / n if n else 0.0
            ss = sum(r["n"] * (r["v"] + (r["m"] - m) ** 2) for r in here if r["n"])
            self.stats[f] = {"n": max(1, n), "std_y_pop": (math.sqrt(ss / n) if n else 0.0) or 1.0, "std_y_samp": (math.sqrt(ss / (n - 1)) if n > 1 else 0.0) or 1.0}
            counts = [sum(r[f"n{i}"] for r in here) for i in range(len(nums))]
            means[f] = [sum(r[f"t{i}"] for r in here if r[f"n{i}"]) / k if k else None for i, k in enumerate(counts)]
        whole = self.folds[-1]
        # the imputer's mean of one row is that row: the same check for columns without a value
        means_of = lambda f: self.train.sparkSession.createDataFrame([tuple(means[f])], T.StructType([T.StructField(c, T.DoubleType()) for c in nums]))
        self.imputer = plan.imputer.fit(means_of(whole))
        for f in self.folds:
            if None in means[f]:
                raise ValueError(f"fold {f} has a column of no values: {[c for c, m in zip(nums, means[f]) if m is None]}")
        # what a null becomes: the mean, in the column's own type
        kinds = {c: self.train.schema[c].dataType for c in nums}
        self.fill = {f: np.array([float(math.trunc(m)) if isinstance(kinds[c], T.IntegralType) else float(np.float32(m)) if isinstance(kinds[c], T.FloatType) else m
                                  for c, m in zip(nums, means[f])]) for f in self.folds}
        self.shift = np.array([*means[whole], sum(r["n"] * r["m"] for r in rows if r["n"]) / self.stats[whole]["n"]])

        pairs = F.array(*[F.struct(F.lit(i).alias("column"), col(c).alias("value")) for i, c in enumerate(cats)])
        below = [F.count(F.when(F.col("s") < f, 1)).alias(f"n{f}") for f in self.folds]
        counts = self.train.select(s.alias("s"), F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(*below, F.min("s").alias("since")).checkpoint(eager=True)
        # the largest count, the smallest value among ties
        best = counts.groupBy("column").agg(*[F.min(F.when(F.col(f"n{f}") > 0, F.struct(-F.col(f"n{f}"), F.col("value").alias("v")))).alias(f"b{f}") for f in self.folds]).collect()
        modes = {f: {cats[r["column"]]: r[f"b{f}"]["v"] for r in best if r[f"b{f}"] is not None} for f in self.folds}
        self.modes = plan.modes.fitted(modes[whole])
        self.indexer = plan.indexer.fitted(counts.select("column", "value"))
        self.sizes = self.indexer.getOrDefault("sizes")
        self.width = len(nums) + plan.tfidf.getOrDefault("maxFeatures") + sum(self.sizes)
        if self.width <= MAX_SLOTS:
            known = self.indexer.dictionary.join(counts.select("column", "value", "since"), ["column", "value"]).select("column", "value", "code", "since").collect()
            code = {(r["column"], r["value"]): r["code"] for r in known}
            self.mode_codes = {f: [code.get((i, modes[f].get(c)), -1) for i, c in enumerate(cats)] for f in self.folds}
            self.since = [np.zeros(n, np.int64) for n in self.sizes]
            for r in known:
                self.since[r["column"]][r["code"]] = r["since"]

    def _count_terms(self) -> None:
        self.texts = self.plan.tfidf.fit_folds(self.train, self.segment, self.folds)
        self.terms = sorted({w for m in self.texts for w in m.getOrDefault("vocabulary")})
        at = {w: i for i, w in enumerate(self.terms)}
        self.vocabulary = {f: np.array([at[w] for w in m.getOrDefault("vocabulary")], np.int64) for f, m in zip(self.folds, self.texts)}
        self.made = {}
        for f, m in zip(self.folds, self.texts):
            weights = np.zeros(len(self.terms))
            weights[self.vocabulary[f]] = m.getOrDefault("idf")
            self.made[f] = _Fold(self.fill[f], self.mode_codes[f], weights)
        self.layout = _Layout(len(self.plan.imputer.getInputCols()), len(self.terms), list(self.sizes))

    def _rows(self) -> DataFrame:
        """(segment, label, numbers, codes, terms and their counts) for the tasks."""
        plan, nums, cats = self.plan, self.plan.imputer.getInputCols(), self.plan.modes.getInputCols()
        out = self.train.where(col(self.label).isNotNull()).select(
            F.col(self.segment).cast("int").alias("s"), col(self.label).cast("double").alias("y"), *[F.coalesce(col(c).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(nums)],
            *[col(c).alias(o) for c, o in zip(cats, self.indexer.getInputCols())], *([plan.tfidf.tokens_of(self.train, plan.tfidf.getInputCol()).alias("_tokens")] if self.terms else []))
        out = self.indexer.transform(out)
        none = F.array()
        if self.terms:
            out = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_tokens", outputCol="_counts").transform(out).withColumn("_counts", F.unwrap_udt("_counts"))
        terms = [F.col("_counts")["indices"], F.col("_counts")["values"]] if self.terms else [none, none]
        return out.select("s", "y", *[f"x{i}" for i in range(len(nums))], *[col(o).cast("int").alias(f"c{i}") for i, o in enumerate(self.indexer.getOutputCols())],
                          F.coalesce(terms[0], none.cast("array<int>")).cast("array<int>").alias("t"), F.coalesce(terms[1], none.cast("array<double>")).cast("array<double>").alias("v"))

    # ------------------------------------------------------------ sums of products

    def _sum_products(self) -> None:
        layout, folds, made, shift = self.layout, self.folds, self.made, self.shift
        step = max(1, _CELLS // layout.width)

        def run(batches):
            sums: dict[int, _Sums] = {}
            plain = np.append(np.arange(layout.numbers + 1), layout.width - 1)
            every = np.arange(layout.width)
            for batch in batches:
                rows = _Rows(batch, layout)
                for s in np.unique(rows.s).tolist():
                    here = rows.s == s
                    same, varied = np.flatnonzero(here & ~rows.varied), np.flatnonzero(here & rows.varied)
                    if len(same):  # in no need of a fold: no terms, nothing to fill
                        d = np.column_stack([np.ones(len(same)), rows.x[same] - shift[:-1], rows.y[same] - shift[-1]])
                        sums.setdefault(s, _Sums(layout)).add(plain, d, [c[same] for c in rows.codes])
                    for lo in range(0, len(varied), step):
                        for f in folds:
                            if s < f:
                                sums.setdefault(-f, _Sums(layout)).add(every, *made[f].block(rows, varied[lo:lo + step], shift))
            for k, m in sums.items():
                i, j, v = m.cells()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i), pa.array(j), pa.array(v)], names=["k", "i", "j", "v"])

        cells = (self._rows().mapInArrow(run, "k int, i int, j int, v double").groupBy("k", "i", "j")
                 .agg(F.sum("v").alias("v"), F.min("v").alias("lo"), F.max("v").alias("hi"))).toArrow()
        k, i, j, v, lo, hi = (c.to_numpy() for c in cells.columns)
        parts = {}
        for key in np.unique(k).tolist():
            m = np.zeros((layout.total, layout.total))
            least, most = np.full(layout.total, np.inf), np.full(layout.total, -np.inf)
            at = (k == key) & (i >= 0)
            m[i[at], j[at]] = m[j[at], i[at]] = v[at]
            at = (k == key) & (i == -1)
            least[j[at]] = lo[at]
            at = (k == key) & (i == -2)
            most[j[at]] = hi[at]
            if key >= 0:  # rows without terms
                t = slice(1 + layout.numbers, 1 + layout.numbers + layout.terms)
                least[t] = most[t] = 0
            parts[key] = m, least, most
        self.moments = {f: self._scaled(f, [p for key, p in parts.items() if key == -f or 0 <= key < f]) for f in self.folds}

    def slots(self, f: int) -> np.ndarray:
        """Places in the sums of a fold's feature slots."""
        at = self.layout
        seen = [k + np.flatnonzero(since < f) for k, since in zip(at.first, self.since)]
        return np.concatenate([np.arange(1, 1 + at.numbers), 1 + at.numbers + self.vocabulary[f], *seen]).astype(int)

    def _scaled(self, f: int, parts: list) -> tuple[Moments, np.ndarray, np.ndarray]:
        """A fold's moments of its scaled features, and their means and variances before."""
        at = self.layout
        if not parts:
            raise ValueError(f"fold {f} has no training rows")
        total = sum(m for m, *_ in parts)
        least, most = np.min([lo for _, lo, _ in parts], axis=0), np.max([hi for *_, hi in parts], axis=0)
        slots = self.slots(f)
        use = np.append(slots, at.total - 1)
        n = total[0, 0]
        mean = total[0, use] / n
        s = total[np.ix_(use, use)] / n - np.outer(mean, mean)
        # a value that never changes has no variance, whatever the rounding says
        held = total[use, use]
        same = np.where((use > at.numbers + at.terms) & (use < at.total - 1), (held == n) | (held == 0), least[use] == most[use])
        s[same], s[:, same] = 0, 0
        shift = np.zeros(at.total)
        shift[1:1 + at.numbers], shift[-1] = self.shift[:-1], self.shift[-1]
        # the mean of a constant is the constant
        mean = np.where(same & np.isfinite(least[use]), least[use], mean) + shift[use]
        numeric = at.numbers + len(self.vocabulary[f])
        mean_x, variance = mean[:numeric].copy(), np.maximum(np.diag(s)[:numeric], 0)
        scale = np.ones(len(use))
        scale[:numeric] = np.where(variance > 0, np.sqrt(variance), 1)
        mean[:numeric] = 0
        s = s / np.outer(scale, scale)
        sums = np.zeros((len(use) + 1, len(use) + 1))
        sums[0, 0], sums[1:, 1:] = n, n * s
        return Moments(sums, mean), mean_x, variance

    # ------------------------------------------------------------ errors, final stages

    def errors(self, spec, together: list) -> list[list[float]]:
        """Mean absolute error of each fold (rows) and parameter set (columns); of the linear models of ``together`` in the same pass."""
        held = [s for s, _ in self._errors]
        if all(s is not spec for s in held):
            self._score([spec, *[s for s in together if s.penalty is not None and s is not spec and all(s is not h for h in held)]])
        return next(maes for s, maes in self._errors if s is spec)

    def _score(self, specs: list) -> None:
        layout, made, fits = self.layout, self.made, {}
        for f in self.folds[:-1]:
            moments, mean, variance = self.moments[f]
            solved = [solve(moments, *spec.penalty(p, moments.n)) for spec in specs for p in spec.grid]
            w, b = np.column_stack([w for w, _ in solved]), np.array([b for _, b in solved])
            k, scale = len(mean), np.where(variance > 0, np.sqrt(variance), 1)
            w[:k] /= scale[:, None]
            b = b - mean @ w[:k]
            whole = np.zeros((layout.total, w.shape[1]))
            whole[self.slots(f)] = w
            whole[0] = b
            fits[f] = whole
        step, place, none, n_fits = max(1, _CELLS // layout.width), layout.place()[:-1], np.zeros(layout.numbers + 1), sum(len(spec.grid) for spec in specs)

        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                rows = _Rows(batch, layout)
                for f in np.unique(rows.s).tolist():
                    here = np.flatnonzero(rows.s == f)
                    for lo in range(0, len(here), step):
                        d, codes = made[f].block(rows, here[lo:lo + step], none)
                        predicted = d[:, :-1] @ fits[f][place]
                        for k, code in zip(layout.first, codes):
                            seen = code >= 0
                            predicted[seen] += fits[f][k + code[seen]]
                        error = np.abs(d[:, -1:] - predicted)
                        sums[f] = sums.get(f, 0) + np.vstack([error.sum(axis=0), np.full(n_fits, len(d))])
            for f, m in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([f] * n_fits, pa.int32()), pa.array(range(n_fits), pa.int32()), pa.array(m[0]), pa.array(m[1])], names=["s", "fit", "e", "n"])

        rows = self._rows().where(F.col("s").isin(list(fits))).mapInArrow(run, "s int, fit int, e double, n double").groupBy("s", "fit").agg((F.sum("e") / F.sum("n")).alias("mae")).collect()
        maes = {f: np.full(n_fits, np.nan) for f in fits}
        for r in rows:
            maes[r["s"]][r["fit"]] = r["mae"]
        at = 0
        for spec in specs:
            self._errors.append((spec, [maes[f][at:at + len(spec.grid)].tolist() for f in fits]))
            at += len(spec.grid)

    def stages(self) -> list:
        """The feature stages, fitted on all rows."""
        plan = self.plan
        _, mean, variance = self.moments[self.folds[-1]]
        codes = self.train.sparkSession.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in self.indexer.getInputCols()]))
        return [self.texts[-1], self.imputer, plan.numbers, plan.scaler.fitted(mean, variance), self.modes, self.indexer,
                plan.encoder.fit(self.indexer.transform(codes)), plan.assembler, plan.counter]

    def fit(self, regressor: LinearRegression):
        """The regressor fitted on all rows: by the normal equations, which know the rows by their means and products only. Points around the means
        along the axes of the products have the same ones, each with the same weight.

        Slots that never change have no part in it: their coefficients are 0. With them, Spark's elimination meets a zero pivot and turns to iterations.
        Unpenalised equations of dependent features (every category column's slots add up to 1) have many solutions. Spark takes the smallest, by
        iterations, if a pivot isn't positive; rounding decides that, and a tiny positive one lets the coefficients run off. A slot that
        is always 0 makes sure of the pivot."""
        moments = self.moments[self.folds[-1]][0]
        s, mean = moments.sums[1:, 1:] / moments.n, moments.shift
        free = np.flatnonzero(np.diag(s) > 0)
        slots = free[free < len(s) - 1]
        points = np.tile(mean, (2, 1))
        if len(free):
            size, axes = np.linalg.eigh(s[np.ix_(free, free)])
            keep = size > 0
            half = (axes[:, keep] * np.sqrt(size[keep] * keep.sum())).T
            points = np.tile(mean, (2 * len(half), 1))
            points[:, free] += np.vstack([half, -half])
        held = not len(slots) or regressor.getRegParam() == 0 and _dependent(s[np.ix_(slots, slots)])
        rows = self.train.sparkSession.createDataFrame([(Vectors.dense([*p[slots], *[0.0] * held]), float(p[-1])) for p in points],
                                                       [regressor.getFeaturesCol(), regressor.getLabelCol()])
        model = regressor.fit(rows)
        weights = np.zeros(len(s) - 1)
        weights[slots] = model.coefficients.toArray()[:len(slots)]
        java = [_py2java(rows.sparkSession.sparkContext, Vectors.dense(weights)), float(model.intercept)]
        return regressor._copyValues(LinearRegressionModel._create_from_java_class("org.apache.spark.ml.regression.LinearRegressionModel", model.uid, *java))


def _dependent(s: np.ndarray) -> bool:
    """Is some feature given by the others, to rounding? (Of features that vary.)"""
    d = np.diag(s)
    size = np.linalg.eigvalsh(s / np.sqrt(np.outer(d, d)))
    return bool(size[0] <= 1e-11 * size[-1])


def fits_by_moments(regressor) -> bool:
    """Is the regressor fitted from means and products alone? (Spark's normal equations.)"""
    return (isinstance(regressor, LinearRegression) and regressor.getSolver() in ("auto", "normal") and regressor.getLoss() == "squaredError"
            and not regressor.isDefined("weightCol"))
