"""Row filters.

The z-score filter (F3) needs the column's mean and population standard
deviation. Without ``by`` they are scalar subqueries of the same DataFrame,
which Catalyst merges into one aggregate (one extra pass over the pruned
column, no shuffle of rows, nothing collected by our code). With ``by`` the
per-group statistics are a grouped aggregate joined back on the group keys;
the stats side has one row per group, so AQE broadcasts it when small and
splits a hot group's partition otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shoplane.functions.text import has_note_date
from shoplane.operators.schema import col, q


def usable_notes(df: DataFrame, note_col: str = "Work Order Internal Note",
                 pattern: str | None = None) -> DataFrame:
    """keep rows whose note is not null, not empty and carries a date."""
    pred = has_note_date(col(note_col)) if pattern is None else has_note_date(col(note_col), pattern)
    return df.filter(pred)


def drop_nulls(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """drop rows null (or NaN) in any ``subset`` column."""
    return df.na.drop(subset=list(subset))


def value_stats(df: DataFrame, value: str) -> tuple[int, tuple[float | None, float | None]]:
    """(rows, (mean, population standard deviation) of ``value``), by one aggregate."""
    x = col(value)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.avg(x).cast("double").alias("m"), F.stddev_pop(x).alias("s")).first()
    return r["n"], (r["m"], r["s"])


def zscore(df: DataFrame, value: str, by: list[str] | None = None, z_col: str = "_z", weight: str | None = None,
           stats: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Attach ``(x - mean) / std_pop`` (null when the std is 0). With ``weight`` (not with ``by``) a row stands for that many rows:
    where rows were counted by value first, the statistics read the counts instead of the rows. ``stats`` are a mean and
    a standard deviation that are known already (``value_stats``)."""
    x = col(value)
    if stats is not None:
        mean, std = (F.lit(v).cast("double") for v in stats)
        return df.withColumn(z_col, F.try_divide(x - mean, std))
    if weight is not None:
        w = F.when(x.isNotNull(), col(weight))
        mean = df.agg((F.sum(x * w) / F.sum(w)).alias("m")).scalar()
        std = df.agg(F.sqrt(F.sum(w * (x - mean) * (x - mean)) / F.sum(w)).alias("s")).scalar()
        return df.withColumn(z_col, F.try_divide(x - mean, std))
    if not by:
        stats = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
        mean, std = stats.select("m").scalar(), stats.select("s").scalar()
        return df.withColumn(z_col, F.try_divide(x - mean, std))
    stats = df.groupBy(*[col(b).alias(f"_zg{i}") for i, b in enumerate(by)]).agg(
        F.avg(x).alias("_zm"), F.stddev_pop(x).alias("_zs"))
    # null-safe: a null group key is a group of its own, its rows are kept
    cond = [col(b).eqNullSafe(F.col(f"_zg{i}")) for i, b in enumerate(by)]
    joined = df.join(stats, cond, "inner")
    return (joined.withColumn(z_col, F.try_divide(x - F.col("_zm"), F.col("_zs")))
            .drop("_zm", "_zs", *[f"_zg{i}" for i in range(len(by))]))


def remove_outliers(df: DataFrame, value: str, threshold: float = 3.0,
                    by: list[str] | None = None,
                    observation: Observation | None = None, weight: str | None = None,
                    stats: tuple[float | None, float | None] | None = None) -> DataFrame:
    """keep rows with ``|z| < threshold`` (strict). A zero standard
    deviation drops every row of its group, as does a null value. ``weight`` and ``stats`` as in ``zscore``.

    F4: pass an ``Observation`` to get ``rows_in``/``rows_out`` after the next
    action, with no extra job.
    """
    z = zscore(df, value, by, "_z", weight, stats)
    keep = F.coalesce(F.abs(F.col("_z")) < threshold, F.lit(False))
    if observation is not None:
        z = z.observe(observation, F.count(F.lit(1)).alias("rows_in"),
                      F.count(F.when(keep, 1)).alias("rows_out"))
    return z.filter(keep).drop("_z")


def removed_counts(df: DataFrame, value: str, threshold: float = 3.0,
                   by: list[str] | None = None) -> DataFrame:
    """F4 as a table: rows before, kept and removed (per group with ``by``)."""
    z = zscore(df, value, by, "_z")
    keep = (F.abs(F.col("_z")) < threshold)
    grp = [col(b) for b in (by or [])]
    agg = [F.count(F.lit(1)).alias("rows_in"),
           F.count(F.when(keep, 1)).alias("rows_kept")]
    out = z.groupBy(*grp).agg(*agg) if grp else z.agg(*agg)
    return out.withColumn("rows_removed", F.col("rows_in") - F.col("rows_kept"))


def drop_nan(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """drop rows whose label/prediction is null or NaN; the row's other
    columns go with it, so nothing has to be re-aligned."""
    pred: Column = F.lit(True)
    for c in cols:
        pred = pred & col(c).isNotNull() & ~F.isnan(col(c))
    return df.filter(pred)


__all__ = ["usable_notes", "drop_nulls", "value_stats", "zscore", "remove_outliers", "removed_counts",
           "drop_nan", "q"]
