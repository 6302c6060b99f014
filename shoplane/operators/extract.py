"""Struct extraction with a pluggable batch extractor.

The extractor is any Python callable ``list[str] -> list[str | dict | None]``
(for instance a client of a model server; the prompt template is its own
business). It is called once per Arrow batch of *distinct* texts inside
``mapInPandas``, on ``parallelism`` partitions; its answers are checkpointed, so
each distinct text is sent once (a failing batch is retried text by text)
however often it repeats and however often the result is read. Answers are
parsed JVM-side (X18: JSON object holding every schema key) and anything else --
bad JSON, missing keys, an exception for one text -- becomes the fallback struct
for that text only. More exceptions than ``max_failed_share`` of the texts fail
the job: an outage must not look like a table of fallbacks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.functions import coerce as C
from shoplane.functions import text as X
from shoplane.operators.schema import col
from shoplane.session import ensure_checkpoint_dir

Extractor = Callable[[list[str]], list]


def _answers(extractor: Extractor, texts: list[str]) -> list[tuple[str | None, bool]]:
    """(answer, failed) of each text."""
    def enc(a):
        return a if a is None or isinstance(a, str) else json.dumps(a)
    try:
        got = list(extractor(texts))
        if len(got) != len(texts):
            raise ValueError("extractor returned a different number of answers")
        return [(enc(a), False) for a in got]
    except Exception:  # noqa: BLE001 -- isolate the failing text(s)
        out = []
        for t in texts:
            try:
                out.append((enc(list(extractor([t]))[0]), False))
            except Exception:  # noqa: BLE001
                out.append((None, True))
        return out


def extract_struct(df: DataFrame, text_col: str, schema: T.StructType, extractor: Extractor,
                   out: str = "extracted", fallback: Callable[[Column], Column] | None = None,
                   blank_is_empty: bool = True, parallelism: int | None = None,
                   max_failed_share: float = 0.5) -> DataFrame:
    """Add ``out`` (struct ``schema``) computed by ``extractor``.

    ``fallback(text_column)`` gives the struct used when the answer is not
    valid; default: empty strings. Null/blank text (any white space) gives
    empty strings without calling the extractor (X19); with
    ``blank_is_empty=False`` a null struct. ``parallelism`` (default: the
    session's default parallelism) is the number of concurrent extractor
    partitions; adaptive execution does not coalesce them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = parallelism or df.sparkSession.sparkContext.defaultParallelism
    blank = F.coalesce(X.strip_ws(col(text_col)) == "", F.lit(True))
    src = df.filter(~blank).select(col(text_col).alias("_t")).distinct().repartition(n)

    def run(batches):
        for pdf in batches:
            texts = pdf["_t"].tolist()
            got = _answers(extractor, texts)
            yield pd.DataFrame({"_t": texts, "_raw": pd.Series([a for a, _ in got], dtype=object),
                                "_failed": [f for _, f in got]})

    answered = src.mapInPandas(run, "_t string, _raw string, _failed boolean").checkpoint(eager=True)
    st = answered.agg(F.count(F.lit(1)).alias("n"), F.count_if("_failed").alias("failed")).first()
    if st["failed"] > max_failed_share * st["n"]:
        raise RuntimeError(f"the extractor failed on {st['failed']} of {st['n']} distinct texts")
    parsed = C.parse_json_struct(F.col("_raw"), schema)
    fb = fallback(F.col("_t")) if fallback else C.empty_struct(schema)
    res = answered.select("_t", F.coalesce(parsed, fb).cast(schema).alias("_val"))
    keep = [col(c) for c in df.columns]
    found = df.filter(~blank).join(res, col(text_col) == res["_t"], "left").select(*keep, F.col("_val").alias(out))
    empty = C.empty_struct(schema).cast(schema) if blank_is_empty else F.lit(None).cast(schema)
    return found.unionByName(df.filter(blank).select(*keep, empty.alias(out)))
