"""Stateless operators on streaming DataFrames.

The reference has no streaming. Every per-row operator here (coercion,
text cleaning, note split, calendar features, model scoring) is a plain
projection, so it applies unchanged to a ``readStream`` DataFrame; nothing
keeps state between micro-batches. Dictionary matching and the extractor need
a join/dedupe, so streams use them per micro-batch via ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplane.functions import coerce as C
from shoplane.functions.dates import calendar_features, repair_duration
from shoplane.operators.notes import split_note
from shoplane.operators.schema import col


def enrich_stream(df: DataFrame, date_in: str = "Date In", date_out: str | None = "Date",
                  note_col: str | None = None) -> DataFrame:
    """Typed dates, repair duration, calendar features and note split on a
    (streaming or batch) DataFrame -- projections only."""
    out = df.withColumn(date_in, C.to_ts(col(date_in), strict=False, dtype=df.schema[date_in].dataType))
    if date_out:
        out = out.withColumn(date_out, C.to_ts(col(date_out), strict=False,
                                               dtype=df.schema[date_out].dataType))
        out = out.withColumn("Repair Duration", repair_duration(col(date_in), col(date_out)))
    out = out.select("*", *[c.alias(k) for k, c in calendar_features(col(date_in)).items()])
    if note_col:
        out = out.withColumn("_note", split_note(col(note_col))).select(
            "*", F.col("_note.cleaned_text").alias("Cleaned Work Order Internal Note"),
            F.col("_note.author").alias("Note Author"), F.col("_note.date").alias("Note Date")).drop("_note")
    return out


def score_stream(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M17 on a stream: a fitted PipelineModel is a chain of projections."""
    return model.transform(df)


def per_batch(fn: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """``foreachBatch`` adapter for operators that join or deduplicate
    (brand matching, extraction): ``fn`` runs on each micro-batch."""
    def run(batch: DataFrame, epoch: int) -> None:
        sink(fn(batch), epoch)
    return run
