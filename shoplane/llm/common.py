"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.session import scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared checkpoint folder and
    read it back: cuts the lineage at a table that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col) -> Column:
    return F.coalesce(col if isinstance(col, Column) else F.col(col), F.lit(""))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (NULL for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(parts)


def worker_state(owner: str) -> dict:
    """A dictionary that outlives a task in a reused Python worker (models and
    tokenizers load once per worker, not once per task). It belongs to one operator at a time: when another
    one asks, what the last one held goes."""
    module = sys.modules.setdefault("_shoplane_worker_state", types.ModuleType("_shoplane_worker_state"))
    held = module.__dict__.setdefault("held", {})
    if owner not in held:
        held.clear()
    return held.setdefault(owner, {})


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary file on the machine that asks: a name is looked up among the installed public
    tokenizers, a path stays."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def bounded_sample(rows: DataFrame, id_col: str, text_col: str, most: int, most_bytes: int) -> DataFrame:
    """At most ``most`` distinct rows (id, text, other columns) of ``rows``, lowest hash of the id first, ties by the text's hash, and not more
    than ``most_bytes`` of text (one row at least). Equal (id, text) pairs are one row, so a repeated id neither fills the sample
    nor breaks its bound. Null ids and texts are left out. What reaches the driver is ids and sizes of the sample."""
    keyed = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    text_hash, order = fresh(rows, "text_hash"), fresh(rows, "id_hash")
    keyed = keyed.withColumn(text_hash, F.xxhash64(text_col)).withColumn(order, F.xxhash64(id_col))
    sizes = keyed.groupBy(order, F.col(id_col), text_hash).agg(F.max(F.octet_length(text_col)).cast("bigint").alias("bytes"))
    chosen, held = [], 0
    for r in sizes.orderBy(order, id_col, text_hash).limit(most).collect():
        if chosen and held + r["bytes"] > most_bytes:
            break
        held += r["bytes"]
        chosen.append((r[id_col], r[text_hash]))
    schema = T.StructType([T.StructField("s_id", rows.schema[id_col].dataType), T.StructField("s_hash", T.LongType())])
    wanted = rows.sparkSession.createDataFrame(chosen, schema)
    met = keyed.join(F.broadcast(wanted), (F.col(id_col) == F.col("s_id")) & (F.col(text_hash) == F.col("s_hash")))  # at most ``most`` rows of two numbers
    others = [c for c in rows.columns if c not in (id_col, text_col)]
    return (met.groupBy(F.col(id_col), text_hash).agg(F.first(text_col).alias(text_col), *[F.min(F.col(f"`{c}`")).alias(c) for c in others])
            .select(*[F.col(f"`{c}`") for c in rows.columns]))
