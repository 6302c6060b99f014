"""Operators over a global row order.

``Window.orderBy`` without ``partitionBy`` puts every row in one task. Here a
total order (``by`` keys, then ``order`` columns ending in a unique key) is
cut into balanced range buckets instead:

1. cut points come from a sample of the (pruned) key columns, 32 keys a bucket
   (``rows_per_bucket`` sets how many buckets), which Spark sorts; one key a
   bucket reaches the driver. Each row's bucket is found by a vectorised binary search in an
   Arrow-batched pandas UDF that only sees the key columns. Ties on a leading
   column are split by the later ones, so a value shared by a third of the
   rows still spreads over many buckets;
2. a narrow aggregate per (group, bucket) gives row counts, first/last
   non-null values (for fills) -- a small table that yields each block's
   start offset and the values carried in from neighbouring blocks;
3. rows at the end of a block that later rows need for lags/rolling means
   ("halo" rows, at most ``reach`` per block) are copied into the next blocks;
4. one window pass partitioned by (group, bucket) computes row index, lags,
   rolling means and fills (of the lags too); halo rows are then dropped.

The data are shuffled once (step 4); steps 1-3 read only key/value columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.functions.dates import wall_clock_micros
from shoplane.operators.schema import col
from shoplane.operators.selection import before, cut_keys, measured_bytes, segment

DEFAULT_ROWS_PER_BUCKET = 250_000
SAMPLE_PER_BUCKET = 32
#: Sampled keys a task sorts.
SAMPLE_PER_TASK = 1 << 16


# ------------------------------------------------------------ key handling

def _whole(x: Column) -> Column:
    """Never null (the null flag beside it orders nulls): a null in an Arrow batch
    would turn the whole batch into floats, which round longs above 2**53."""
    return F.coalesce(x.cast("long"), F.lit(0).cast("long"))


def _decimal_parts(x: Column, dt: T.DecimalType) -> list[Column]:
    """The unscaled number as one long, or from its digits as three longs of 13 digits, each with its
    sign: they sort as the decimals do, exactly (a double holds 53 bits, a long 18 digits)."""
    if dt.precision <= 18:
        scale = F.lit("1" + "0" * dt.scale).cast(T.DecimalType(dt.scale + 1, 0))
        return [_whole(x * scale)]
    whole = dt.precision - dt.scale
    digits = F.to_char(x, F.lit("MI" + "0" * whole + ("D" + "0" * dt.scale if dt.scale else "")))
    digits = F.lpad(F.regexp_replace(digits, "[^0-9]", ""), 39, "0")
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))
    return [_whole(sign * digits.substr(k, 13).cast("long")) for k in (1, 14, 27)]


def _components(df: DataFrame, cols: list[str]) -> tuple[list[Column], list[str]]:
    """Sortable primitive components of the order (nulls last, NaN after all
    numbers, as Spark sorts ascending with nulls last) and their kinds."""
    comps, kinds = [], []
    for c in cols:
        dt = df.schema[c].dataType
        x = col(c)
        comps.append(x.isNull().cast("int"))
        kinds.append("int")
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            comps.append(F.coalesce(F.isnan(x), F.lit(False)).cast("int"))
            kinds.append("int")
            comps.append(F.coalesce(F.when(~F.isnan(x), x.cast("double")), F.lit(0.0)))
            kinds.append("float")
        elif isinstance(dt, T.TimestampNTZType):
            comps.append(_whole(wall_clock_micros(x)))
            kinds.append("int")
        elif isinstance(dt, T.TimestampType):
            comps.append(_whole(F.unix_micros(x)))
            kinds.append("int")
        elif isinstance(dt, T.DateType):
            comps.append(_whole(F.unix_date(x)))
            kinds.append("int")
        elif isinstance(dt, T.BooleanType):
            comps.append(_whole(x.cast("int")))
            kinds.append("int")
        elif isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            comps.append(_whole(x))
            kinds.append("int")
        elif isinstance(dt, T.DecimalType):
            parts = _decimal_parts(x, dt)
            comps += parts
            kinds += ["int"] * len(parts)
        elif isinstance(dt, T.StringType):
            comps.append(F.coalesce(x, F.lit("")))
            kinds.append("str")
        else:
            raise TypeError(f"unsupported order column type {dt} for {c}")
    return comps, kinds


def _rank_codes(values: np.ndarray, uniq: np.ndarray) -> np.ndarray:
    """One key dimension in the rank space of its cut values: equal to cut value
    i -> 2i+1, strictly between (or outside) -> even."""
    i = np.searchsorted(uniq, values, side="left")
    hit = np.zeros(len(values), dtype=bool)
    inside = i < len(uniq)
    hit[inside] = uniq[i[inside]] == values[inside]
    return 2 * i.astype(np.int64) + hit


_DTYPES = {"int": np.int64, "float": np.float64, "str": object}


@dataclass
class _Cuts:
    """Ascending cut tuples. A row's bucket is the number of cuts at or below it,
    found one key dimension at a time: among the cuts that agree with the row so
    far, ``searchsorted`` either settles its place or names the next agreeing run."""

    cuts: list[tuple]
    kinds: list[str]

    def prepare(self):
        run = np.zeros(len(self.cuts), np.int64)  # cuts equal in all earlier dimensions share a run
        self.uniq, self.codes, self.runs = [], [], []
        for j, kind in enumerate(self.kinds):
            values = np.array([c[j] for c in self.cuts], dtype=_DTYPES[kind])
            uniq = np.array(sorted(set(values.tolist())), dtype=_DTYPES[kind])
            codes = run * (2 * len(uniq) + 2) + _rank_codes(values, uniq)
            run = np.cumsum(np.r_[False, codes[1:] != codes[:-1]])
            self.uniq.append(uniq)
            self.codes.append(codes)
            self.runs.append(run)
        return self

    def assign(self, cols: list[pd.Series]) -> np.ndarray:
        n = len(cols[0])
        place, run, open_rows = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        for series, kind, uniq, codes, runs in zip(cols, self.kinds, self.uniq, self.codes, self.runs):
            values = series.to_numpy(dtype=_DTYPES[kind])[open_rows]
            code = run[open_rows] * (2 * len(uniq) + 2) + _rank_codes(values, uniq)
            left, right = (np.searchsorted(codes, code, side=side) for side in ("left", "right"))
            place[open_rows] = right
            meets = left < right
            run[open_rows[meets]] = runs[left[meets]]
            open_rows = open_rows[meets]
        return place.astype(np.int32)


def _cut_points(keys: DataFrame, share: float, every: int, expected: int, seed: int) -> list[tuple]:
    """Every ``every``-th key of a sorted sample of ``keys``, ascending and
    distinct. Spark sorts the sample in ranges; a range's last, shorter run of
    keys joins the next range's first."""
    names = keys.columns
    ranges = max(1, math.ceil(expected / SAMPLE_PER_TASK))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the range
    picked = (keys.sample(False, share, seed).repartitionByRange(ranges, *names).sortWithinPartitions(*names)
              .withColumn("_place", place).where(F.col("_place") % every == every - 1).drop("_place"))
    return sorted({tuple(r.values()) for r in picked.toArrow().to_pylist()})


def assign_buckets(df: DataFrame, keys: list[str], rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                   seed: int = 42, bucket_col: str = "_b") -> tuple[DataFrame, int]:
    """Add ``bucket_col``: range bucket of the row in the order of ``keys``.
    Returns the frame and the number of buckets."""
    comps, kinds = _components(df, keys)
    key_frame = df.select(*[c.alias(f"c{i}") for i, c in enumerate(comps)])
    n = key_frame.count()
    nb = max(1, math.ceil(n / max(1, rows_per_bucket)))
    cuts: list[tuple] = []
    share = min(1.0, nb * SAMPLE_PER_BUCKET / max(1, n))
    while nb > 1:
        cuts = _cut_points(key_frame, share, max(1, int(share * rows_per_bucket)), int(share * n), seed)
        if cuts or share == 1.0:
            break
        share, seed = min(1.0, 4 * share), seed + 1  # an unlucky draw: take a larger one rather than one bucket
    if not cuts:
        return df.withColumn(bucket_col, F.lit(0)), 1
    spec = _Cuts(cuts, kinds).prepare()

    @F.pandas_udf("int")
    def bucket_of(*cols: pd.Series) -> pd.Series:
        return pd.Series(spec.assign(list(cols)))

    return df.withColumn(bucket_col, bucket_of(*comps)), len(cuts) + 1


# --------------------------------------------------------- ordered frame

def _type_default(dt: T.DataType) -> Column:
    """A non-null stand-in of the type (paired with an is-null flag)."""
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, (T.NumericType,)):
        return F.lit("0").cast(dt)
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(dt)
    raise TypeError(f"unsupported group key type {dt}")


def _order_spec(order: list[str]) -> list[Column]:
    return [col(c).asc_nulls_last() for c in order]


def ordered_features(df: DataFrame, order: list[str], by: list[str] | None = None, *,
                     index_col: str | None = "row_idx",
                     lag_col: str | None = None, lags: tuple[int, ...] = (),
                     rolling: int = 0, rolling_name: str | None = None,
                     fill_cols: list[str] | None = None, fill_derived: bool = False,
                     rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, seed: int = 42,
                     summary_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """All ordered operators in one pass.

    ``order`` must end in a unique key (total order). Adds ``index_col``
    (0-based position within the ``by`` group, W5), ``lag_<k>`` of ``lag_col``
    for each k in ``lags`` (W1), the trailing mean of ``rolling`` rows named
    ``rolling_name`` (null unless all ``rolling`` values are non-null, W2), and
    fills ``fill_cols`` backward then forward (W3, W4). ``fill_derived`` fills the lags and
    the rolling mean in the same buckets: what they carry across buckets comes from a pass over the keys and
    ``lag_col`` alone, so the rows are still shuffled once. ``by`` and ``order`` columns are not filled.
    """
    by = list(by or [])
    fill_cols = list(fill_cols or [])
    keys = by + list(order)
    reach = max([*lags, rolling - 1 if rolling else 0, 0])
    bdf, nb = assign_buckets(df, keys, rows_per_bucket, seed)
    # group keys as (is-null flag, non-null surrogate): plain equi-join keys,
    # so the summary join and the window share one hash partitioning
    gkeys = []
    for i, b in enumerate(by):
        bdf = bdf.withColumn(f"_gn{i}", col(b).isNull()).withColumn(
            f"_gk{i}", F.coalesce(col(b), _type_default(df.schema[b].dataType)))
        gkeys += [f"_gn{i}", f"_gk{i}"]
    blk = gkeys + ["_b"]
    ocomps, _ = _components(df, list(order))
    okey = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ocomps)])  # nulls-last order

    rolled = rolling_name or f"rolling_mean_{rolling}"
    w = Window.partitionBy(*[col(b) for b in blk]).orderBy(*_order_spec(order))
    # reversed order (same partitioning, no extra shuffle) for look-ahead fills
    w_rev = Window.partitionBy(*[col(b) for b in blk]).orderBy(*[col(c).desc_nulls_first() for c in order])
    gw = Window.partitionBy(*gkeys).orderBy("_b")
    prev = gw.rowsBetween(Window.unboundedPreceding, -1)
    # "from the next row to the end" as the growing frame of the reversed order:
    # Spark re-aggregates an unbounded-following frame for every row (O(n^2))
    nxt = Window.partitionBy(*gkeys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)

    def ends(names: list[str]) -> list[Column]:
        """First and last non-null value of each column in a block."""
        out = []
        for c in names:
            has = F.when(col(c).isNotNull(), okey)
            out += [F.min_by(col(c), has).alias(f"_first_{c}"), F.max_by(col(c), has).alias(f"_last_{c}")]
        return out

    def carries(names: list[str]) -> list[Column]:
        """Of each column, the nearest values in earlier and in later blocks."""
        out = []
        for c in names:
            out += [F.last(col(f"_last_{c}"), ignorenulls=True).over(prev).alias(f"_carry_prev_{c}"),
                    F.last(col(f"_first_{c}"), ignorenulls=True).over(nxt).alias(f"_carry_next_{c}")]
        return out

    def lagged() -> dict[str, Column]:
        out = {f"lag_{k}": F.lag(col(lag_col), k).over(w) for k in lags}
        if rolling:
            rw = w.rowsBetween(-(rolling - 1), 0)
            out[rolled] = F.when(F.count(col(lag_col)).over(rw) == rolling, F.avg(col(lag_col)).over(rw))
        return out

    # --- per-block summary: counts and first/last non-null fill values
    summ = bdf.groupBy(*[col(b) for b in blk]).agg(F.count(F.lit(1)).alias("_cnt"), *ends(fill_cols))
    cols = [*[col(b) for b in blk], "_cnt", F.coalesce(F.sum("_cnt").over(prev), F.lit(0)).alias("_start"), *carries(fill_cols)]
    if reach:
        # bucket id and start offset of the next `reach` blocks of the group
        cols += [F.lead("_b", k).over(gw).alias(f"_nb{k}") for k in range(1, reach + 1)]
    summ = summ.select(*cols)
    if reach:
        summ = summ.select("*", *[F.lead("_start", k).over(gw).alias(f"_ns{k}") for k in range(1, reach + 1)])
    summ = summ.checkpoint(eager=True)

    def measured(table: DataFrame) -> DataFrame:
        """One row per (group, bucket): broadcast only under a measured bound."""
        return F.broadcast(table) if measured_bytes(table) <= summary_broadcast_bytes else table

    small = measured(summ)
    base = bdf.withColumn("_halo", F.lit(False))
    if reach:
        # --- halo rows: the last `reach` rows of each block, copied forward
        narrow = [*gkeys, "_b", *[col(c) for c in order]]
        if lag_col and lag_col not in list(order):
            narrow.append(col(lag_col))
        narrow = bdf.select(*narrow)
        tails = narrow.withColumn("_rfe", F.row_number().over(w_rev)).filter(F.col("_rfe") <= reach)
        tails = tails.join(small.select(*blk, "_cnt", "_start",
                                        *[f"_nb{k}" for k in range(1, reach + 1)],
                                        *[f"_ns{k}" for k in range(1, reach + 1)]), blk)
        tails = tails.withColumn("_gidx", F.col("_start") + F.col("_cnt") - F.col("_rfe"))
        targets = F.array(*[F.struct(F.col(f"_nb{k}").alias("b"), F.col(f"_ns{k}").alias("s"))
                            for k in range(1, reach + 1)])
        halos = (tails.withColumn("_t", F.explode(targets))
                 .filter(F.col("_t.b").isNotNull() & (F.col("_t.s") - reach <= F.col("_gidx")))
                 .withColumn("_b", F.col("_t.b"))
                 .select(*narrow.columns)
                 .withColumn("_halo", F.lit(True))).checkpoint(eager=True)  # `reach` keys and values a block
        base = base.unionByName(halos, allowMissingColumns=True)
        if fill_derived:
            # lags of the block's own rows, from keys and values only; then their ends a block
            own = narrow.withColumn("_halo", F.lit(False)).unionByName(halos).select("*", *[c.alias(n) for n, c in lagged().items()]).filter(~F.col("_halo"))
            names = list(lagged())
            derived = own.groupBy(*[col(b) for b in blk]).agg(*ends(names)).select(*blk, *carries(names))
            summ = summ.join(measured(derived.checkpoint(eager=True)), blk).checkpoint(eager=True)
            small = measured(summ)

    joined = base.join(small, blk)
    added = lagged() if reach else {}
    if index_col:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nhalo = F.sum(F.col("_halo").cast("int")).over(whole)
        added[index_col] = F.col("_start") + F.row_number().over(w) - 1 - nhalo
    to_fill = fill_cols + (list(lagged()) if fill_derived and reach else [])
    # a halo row's own lags lack their history: they count for no fill
    added = {n: F.when(~F.col("_halo"), c) if n in to_fill else c for n, c in added.items()}
    carried = [f"_carry_{side}_{c}" for c in to_fill for side in ("next", "prev")]
    res = joined.select(*[col(c) for c in df.columns], *[c.alias(n) for n, c in added.items()], "_halo",
                        *([*blk, *[col(c) for c in carried]] if to_fill else []))

    def filled(c: str) -> Column:
        nxt_in = F.last(col(c), ignorenulls=True).over(w_rev.rowsBetween(Window.unboundedPreceding, 0))
        prv_in = F.last(col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return F.coalesce(col(c), nxt_in, col(f"_carry_next_{c}"), prv_in, col(f"_carry_prev_{c}")).alias(c)

    if to_fill:
        res = res.select(*[filled(c) if c in to_fill else col(c) for c in [*df.columns, *added]], "_halo")
    return res.filter(~F.col("_halo")).drop("_halo")


def ordered_index(df: DataFrame, order: list[str], by: list[str] | None = None,
                  index_col: str = "row_idx", **kw) -> DataFrame:
    """0-based position of each row in the total order (per ``by`` group)."""
    return ordered_features(df, order, by, index_col=index_col, **kw)


def lag_features(df: DataFrame, value: str, order: list[str], by: list[str] | None = None,
                 lags: tuple[int, ...] = (1, 2), rolling: int = 3,
                 rolling_name: str = "rolling_mean_3", **kw) -> DataFrame:
    """W1 + W2: ``lag_1``, ``lag_2`` and the trailing mean of 3 rows."""
    return ordered_features(df, order, by, index_col=None, lag_col=value, lags=lags,
                            rolling=rolling, rolling_name=rolling_name, **kw)


def fill_gaps(df: DataFrame, order: list[str], cols: list[str] | None = None,
              by: list[str] | None = None, **kw) -> DataFrame:
    """W3 + W4: backward fill, then forward fill what is left (trailing nulls)."""
    cols = [c for c in (cols or df.columns) if c not in set(order) | set(by or [])]
    return ordered_features(df, order, by, index_col=None, fill_cols=cols, **kw)


def sort_by(df: DataFrame, order: list[str]) -> DataFrame:
    """O1: global sort, nulls last (range-partitioned sort by Spark)."""
    return df.orderBy(*_order_spec(order))


def time_split(df: DataFrame, order: list[str], ratio: float = 0.9, index_col: str | None = None,
               **kw) -> tuple[DataFrame, DataFrame]:
    """O2: first ``int(ratio * n)`` rows (in order) train, the rest test. Both are the table behind a predicate
    on its order columns: the key at the cut is found by radix selection (``selection``), no row is numbered. With ``index_col`` the
    rows also carry their position (W5; ``kw`` as there)."""
    if index_col:
        df = ordered_index(df, order, index_col=index_col, **kw)
    n, keys = cut_keys(df, order, lambda n: [int(ratio * n)] if int(ratio * n) < n else [])
    if not keys:
        return df, df.limit(0)
    train = before(df, order, keys[0])
    return df.where(train), df.where(~train)


def time_folds(n: int, n_splits: int = 5) -> list[tuple[int, int, int]]:
    """O3: expanding-window folds as (train_end, test_start, test_end) index
    bounds: test size ``n // (n_splits + 1)``, training = everything before."""
    size = n // (n_splits + 1)
    if size == 0:
        raise ValueError(f"too few rows ({n}) for {n_splits} folds")
    starts = range(n - n_splits * size, n, size)
    return [(s, s, s + size) for s in starts]


def fold_frames(indexed: DataFrame, n: int, n_splits: int = 5, index_col: str = "row_idx"):
    """O3 applied: (train, test) frames per fold as predicates on the index."""
    ix = F.col(index_col)
    return [(indexed.filter(ix < tr_end), indexed.filter((ix >= s) & (ix < e)))
            for tr_end, s, e in time_folds(n, n_splits)]


def time_segments(df: DataFrame, order: list[str], n_splits: int = 5, segment_col: str = "segment") -> tuple[DataFrame, int]:
    """O3 as one column: ``segment_col`` is 0 for rows before the first fold's test rows and ``i`` for the test rows of fold
    ``i`` (from 1). Fold i trains on all segments below i. Returns the frame and the number of rows. The fold bounds are keys
    found together by radix selection; a row's segment is a sum of predicates on its order columns."""
    n, keys = cut_keys(df, order, lambda n: [start for start, *_ in time_folds(n, n_splits)])
    return df.withColumn(segment_col, segment(df, order, keys)), n


def segment_folds(segmented: DataFrame, n_splits: int = 5, segment_col: str = "segment"):
    """(train, test) frames of each fold of ``time_segments``."""
    at = F.col(segment_col)
    return [(segmented.filter(at < i), segmented.filter(at == i)) for i in range(1, n_splits + 1)]
