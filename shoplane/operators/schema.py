"""Schema and projection operators.

All are projections: narrow, no shuffle, fused into the scan's codegen stage.
Checks (P2) run on the driver against ``df.columns`` and touch no data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.functions import coerce as C


def q(name: str) -> str:
    """Backtick-quote a column name (names such as ``WO#`` or with blanks)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(q(name))


def trim_column_names(df: DataFrame) -> DataFrame:
    """Strip surrounding whitespace from every column name.

    Raises ``ValueError`` when two names collide after stripping.
    """
    new = [c.strip() for c in df.columns]
    dup = sorted({c for c in new if new.count(c) > 1})
    if dup:
        raise ValueError(f"column names collide after stripping: {dup}")
    return df.toDF(*new)


def require_columns(df: DataFrame, cols: Iterable[str], error: type = KeyError) -> DataFrame:
    """Fail with the missing names unless every column is present."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise error(f"missing required columns: {missing}; present: {df.columns}")
    return df


def build_text(df: DataFrame, target: str, left: str, right: str) -> DataFrame:
    """``target = coalesce(left,'') || ' ' || coalesce(right,'')`` unless
    ``target`` already exists. (``concat_ws`` would drop the blank.)"""
    if target in df.columns:
        return df
    require_columns(df, [left, right])
    return df.withColumn(target, F.concat(F.coalesce(col(left), F.lit("")), F.lit(" "),
                                          F.coalesce(col(right), F.lit(""))))


def fill_unknown(df: DataFrame, cols: Iterable[str], value: str = "Unknown") -> DataFrame:
    """Categorical nulls -> ``value``."""
    return df.fillna(value, subset=list(cols))


def coerce_types(df: DataFrame, dates: Iterable[str] = ("Date In", "Due On", "Date"),
                 quantities: Iterable[str] = ("Qty",), dollars: Iterable[str] = (),
                 date_formats: list[str] | None = None, day_first: bool = False) -> DataFrame:
    """P10: one projection applying, by precedence, lenient timestamp parsing
    (P6, ``date_formats`` and ``day_first`` as there), quantity coercion (P7), dollar coercion (P8) and stringification of
    the remaining non-numeric, non-temporal columns (P9, NULL kept)."""
    dates, quantities, dollars = set(dates), set(quantities), set(dollars)
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in dates:
            e = C.to_ts(c, strict=False, formats=date_formats, dtype=f.dataType, day_first=day_first)
        elif f.name in quantities:
            e = C.to_quantity(c)
        elif f.name in dollars:
            e = C.to_dollars(c)
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType,
                                     T.TimestampType, T.TimestampNTZType)):
            e = c
        else:
            e = C.to_text(c)
        out.append(e.alias(f.name))
    return df.select(*out)


def struct_to_columns(df: DataFrame, struct_col: str, mapping: dict[str, str]) -> DataFrame:
    """``mapping`` = {field: new column}; the struct column is dropped."""
    extra = [F.col(q(struct_col))[k].alias(v) for k, v in mapping.items()]
    return df.select("*", *extra).drop(struct_col)


def drop_if_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns, ignoring absent ones."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present) if present else df


def select_features(df: DataFrame, cols: Iterable[str], extra: Iterable[str] = ()) -> DataFrame:
    """Check then project the feature columns (plus ``extra``)."""
    cols = list(cols) + [c for c in extra if c not in cols]
    require_columns(df, cols)
    return df.select(*[col(c) for c in cols])


def cast_float32(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P14."""
    cols = set(cols)
    return df.select(*[(C.to_float32(col(c)) if c in cols else col(c)).alias(c) for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its scan has fewer partitions than there are cores (a table of few row groups), for heavy work on
    single rows. A table of more partitions is left as it is: nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
