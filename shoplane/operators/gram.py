"""Linear models of a whole grid from sums of products.

A least-squares fit with any ridge, lasso or elastic-net penalty needs only the
Gram matrix of (1, features, label). One aggregate yields it for every time segment;
as sums add up, an expanding fold's matrix is a prefix sum of its segments', and
each fold's whole grid is solved on the driver from matrices of slots x slots, whatever the
number of rows. A second aggregate scores all fits of all folds at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feature slots up to which grids are solved this way (a matrix of 8 MB).
MAX_SLOTS = 1024
#: Matrix cells of the rows that a task expands at once.
_CELLS = 1 << 22


def _dense_parts(vectors: pa.Array, slots: int):
    """(first row, dense matrix) of consecutive rows of an unwrapped vector column."""
    kind, indices, values = (vectors.field(f) for f in ("type", "indices", "values"))
    step = max(1, _CELLS // max(1, slots))
    for lo in range(0, len(vectors), step):
        val, ind = values.slice(lo, step), indices.slice(lo, step)
        lens = np.diff(np.asarray(val.offsets)).astype(np.int64)
        row = np.repeat(np.arange(len(val)), lens)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)  # dense: the place in the row
        sparse = np.asarray(kind.slice(lo, step))[row] == 0
        at[sparse] = np.asarray(ind.flatten())
        out = np.zeros((len(val), slots))
        out[row, at] = np.asarray(val.flatten())
        yield lo, out


def _columns(df: DataFrame, features: str, label: str, segment: str) -> DataFrame:
    """(s, x, y) for the tasks. A dense vector's missing indices are an empty list: Arrow's writer looks through the batch's lists again
    with every row if some are null."""
    rows = df.select(F.col(segment).cast("int").alias("s"), F.unwrap_udt(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    whole = F.struct("x.type", F.coalesce("x.indices", F.array().cast("array<int>")).alias("indices"), "x.values")
    return rows.select("s", whole.alias("x"), "y")


def slots_of(df: DataFrame, features: str = "features") -> int:
    """Length of the feature vectors (from one row; 0 for an empty table)."""
    row = df.select(F.unwrap_udt(F.col(features)).alias("x")).select(F.coalesce("x.size", F.size("x.values")).alias("n")).first()
    return row["n"] if row else 0


@dataclass
class Moments:
    """Sums of products of (1, features - shift, label - shift): they add up."""

    sums: np.ndarray
    shift: np.ndarray  # of the features, then of the label

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.sums + other.sums, self.shift)

    @property
    def n(self) -> float:
        return self.sums[0, 0]

    def centred(self):
        """(feature means, label mean, centred X'X / n, centred X'y / n, label variance)."""
        mean = self.sums[0, 1:] / self.n
        s = self.sums[1:, 1:] / self.n - np.outer(mean, mean)
        mean = mean + self.shift
        return mean[:-1], mean[-1], s[:-1, :-1], s[:-1, -1], s[-1, -1]


def segment_moments(df: DataFrame, features: str = "features", label: str = "label", segment: str = "segment") -> dict[int, Moments]:
    """Moments of every segment, by one aggregate: each task adds up its rows' products, Spark adds up the cells."""
    slots = slots_of(df, features)
    if not slots:
        return {}
    first = _columns(df, features, label, segment).where("y IS NOT NULL").limit(1).toArrow()
    # sums around any row keep their digits where the means are large
    shift = np.append(next(_dense_parts(first.column("x").combine_chunks(), slots))[1][0], first.column("y")[0].as_py()) if len(first) else np.zeros(slots + 1)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            seg, y = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, x in _dense_parts(batch.column(1), slots):
                z = np.column_stack([np.ones(len(x)), x - shift[:-1], y[lo:lo + len(x)] - shift[-1]])
                for s in np.unique(seg[lo:lo + len(x)]).tolist():
                    part = z[seg[lo:lo + len(x)] == s]
                    sums[s] = sums.get(s, 0) + part.T @ part
        i, j = np.triu_indices(slots + 2)
        for s, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), s, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(m[i, j])], names=["s", "i", "j", "v"])

    cells = (_columns(df, features, label, segment).where("s IS NOT NULL AND y IS NOT NULL").mapInArrow(run, "s int, i int, j int, v double")
             .groupBy("s", "i", "j").agg(F.sum("v").alias("v"))).toArrow()
    s, i, j, v = (c.to_numpy() for c in cells.columns)
    out = {}
    for k in np.unique(s).tolist():
        m, at = np.zeros((slots + 2, slots + 2)), s == k
        m[i[at], j[at]] = m[j[at], i[at]] = v[at]
        out[k] = Moments(m, shift)
    return out


def solve(m: Moments, l1: float, l2: float, tol: float = 1e-12, max_sweeps: int = 100_000) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) that minimise 1/(2n) |y - Xw - b|^2 + l1 |w|_1 + l2/2 |w|^2: the normal equations, or with
    ``l1`` coordinate descent on the covariances, where a step costs one column whatever the number of rows."""
    mean_x, mean_y, q, c, var_y = m.centred()
    if l1 == 0:
        a = q + l2 * np.eye(len(c))
        w = np.linalg.lstsq(a, c, rcond=None)[0] if l2 == 0 else np.linalg.solve(a, c)
        return w, mean_y - mean_x @ w
    w, qw, d = np.zeros(len(c)), np.zeros(len(c)), np.diag(q).copy()
    scale = tol * max(np.sqrt(max(var_y, 0.0)), 1e-300)
    every, active = np.flatnonzero(d + l2 > 0), None
    for _ in range(max_sweeps):
        most = 0.0
        for j in every if active is None else active:
            g = c[j] - qw[j] + d[j] * w[j]
            new = np.sign(g) * max(abs(g) - l1, 0.0) / (d[j] + l2)
            step = new - w[j]
            if step:
                w[j] = new
                qw += q[:, j] * step
                most = max(most, abs(step) * np.sqrt(d[j] + l2))
        if most <= scale:
            if active is None:
                break
            active = None  # settled among the chosen slots: look at all again
        else:
            active = np.flatnonzero(w) if active is None else active
    return w, mean_y - mean_x @ w


def segment_errors(df: DataFrame, fits: dict[int, tuple[np.ndarray, np.ndarray]], features: str = "features", label: str = "label",
                   segment: str = "segment") -> dict[int, np.ndarray]:
    """Mean absolute error of every fit of a segment on the segment's rows: ``fits`` has (slots x fits, intercepts) by segment."""
    if not fits:
        return {}
    slots = len(next(iter(fits.values()))[0])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            seg, y = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, x in _dense_parts(batch.column(1), slots):
                here = seg[lo:lo + len(x)]
                for s in np.unique(here).tolist():
                    w, b = fits[s]
                    at = here == s
                    error = np.abs(y[lo:lo + len(x)][at][:, None] - x[at] @ w - b)
                    sums[s] = sums.get(s, 0) + np.vstack([error.sum(axis=0), np.full(w.shape[1], len(error))])
        for s, m in sums.items():
            n = m.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([s] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m[0]), pa.array(m[1])],
                                             names=["s", "fit", "e", "n"])

    rows = (_columns(df, features, label, segment).where(F.col("s").isin(list(fits)) & F.col("y").isNotNull())
            .mapInArrow(run, "s int, fit int, e double, n double").groupBy("s", "fit").agg((F.sum("e") / F.sum("n")).alias("mae")).collect())
    out = {s: np.full(w.shape[1], np.nan) for s, (w, _) in fits.items()}
    for r in rows:
        out[r["s"]][r["fit"]] = r["mae"]
    return out


def grid_errors(df: DataFrame, penalties, n_splits: int, features: str = "features", label: str = "label", segment: str = "segment") -> list[list[float]]:
    """Mean absolute error of each fold (rows) and penalty (columns): fold i is fitted on the segments below i and scored on segment i.
    ``penalties`` are functions of the training rows' number that return (l1, l2)."""
    moments = segment_moments(df.where(F.col(segment) < n_splits), features, label, segment)  # nothing is fitted on the last segment
    fits, total = {}, None
    for s in range(n_splits + 1):
        if s and total is not None:
            solved = [solve(total, *p(total.n)) for p in penalties]
            fits[s] = (np.column_stack([w for w, _ in solved]), np.array([b for _, b in solved]))
        if s in moments:
            total = moments[s] if total is None else total + moments[s]
    errors = segment_errors(df, fits, features, label, segment)
    return [errors[s].tolist() for s in range(1, n_splits + 1)]
