"""The corpus pipeline: each stage applies one operator of ``shoplane.llm`` to all
that the stage before it kept. A stage takes (spark, docs, sf_dir) and returns the
columns of documents; the last returns the token file's document index.

Null, empty and repeated rows follow the operators' docstrings: texts without a
letter are rejected by the first stage, so none reaches the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoplane.llm.common import fresh, materialize, table
from shoplane.session import ensure_checkpoint_dir, scratch_path

TOKENIZER = "word_bpe_49k.json"
#: Rows of an Arrow batch: whole texts go through Python, so fewer than Spark's 10,000 are held at once.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= BATCH_ROWS:
        spark.conf.set(conf, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a determinable language; the others (no letter, or no learned profile knows them) go."""
    from shoplane.llm.language_id import reject_undetermined
    _small_batches(spark)
    return reject_undetermined(docs, per_language=800, dim=1024, ngram=3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    from shoplane.llm.simhash import drop_near_duplicates
    _small_batches(spark)
    return drop_near_duplicates(docs, ngram=3, seed=42, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    from shoplane.llm.decontaminate import drop_contaminated
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that every source has an equal share of the characters on average."""
    from shoplane.llm.mix import mix_sources
    copy_col, order_col = fresh(docs, "copy_no"), fresh(docs, "shuffle_key")
    return mix_sources(docs, weights=None, seed=42, copy_col=copy_col, order_col=order_col, by_text=True).drop(copy_col, order_col)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the operator's file format; the index read back from them."""
    from shoplane.llm.token_file import read_documents, write_token_files
    _small_batches(spark)
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, TOKENIZER, end_id=1, max_bytes=48 << 20)
    return read_documents(spark, path)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_output", token_output),
]

#: Hyperdimensional profiles, SimHash components and the vocabulary's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
