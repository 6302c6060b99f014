"""Table sources and sinks.

Reads are lazy; Catalyst prunes columns and pushes filters into the Parquet
scan. Exported worksheets are read as CSV with an explicit schema (no schema
inference pass over the data) and coerced afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet scan (a file, a folder, a glob or a list of them)."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def read_sheet(spark: SparkSession, path: str | Sequence[str],
               schema: T.StructType | str | None = None, columns: Iterable[str] | None = None,
               sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Exported worksheet(s) (CSV with a header row), many files at once.

    With no ``schema`` every column is read as text (``columns`` names them;
    else each path's header does), leaving typing to ``coerce_types`` -- Spark never
    scans the data to infer types. Paths whose headers differ in order or names are aligned by name, in the
    first one's order, with nulls where a sheet lacks a column; inside one path (a folder) a file of another
    header fails instead of filling the wrong columns. ``multi_line=False`` is for sheets without line breaks in cells:
    their files can be split between tasks.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line) \
        .option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False)
    if schema is None and columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    paths = [path] if isinstance(path, str) else list(path)
    if schema is not None:
        return reader.schema(schema).csv(paths)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        by_header.setdefault(tuple(spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"').csv(p).columns), []).append(p)
    frames = [reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(same) for header, same in by_header.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def records_to_df(spark: SparkSession, records: list[dict] | dict,
                  schema: T.StructType | str) -> DataFrame:
    """One or more records (dicts) to a DataFrame with a fixed schema."""
    rows = [records] if isinstance(records, dict) else list(records)
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = [f.name for f in st.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], st)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] | None = None,
                mode: str = "overwrite") -> None:
    """Parquet sink, optionally partitioned (enables partition pruning)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header row (metric and coefficient tables)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_sheet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Inverse of S2 (used to export tables as sheets)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
