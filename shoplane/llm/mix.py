"""Mixing sources to target weights by Poisson replication (DataFrame operations only).

Every source gets the rate ``weight * target size / its size``. Each document
draws its number of copies from a Poisson distribution of that mean, by
inverting the distribution at a uniform number that a seeded hash of its id
gives, is exploded by the count, and all copies are put in a global hash order.

A rate above ``STEP`` is drawn as the sum of equal independent Poisson parts (a
sum of Poissons is Poisson), so the inversion table stays short at any rate.
Documents of more than ``CHUNK`` parts (tiny sources) are drawn and exploded in
chunks of so many parts, dealt to tasks by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplane.llm.common import fresh, materialize, text_or_empty

#: Largest mean that one inversion draws.
STEP = 8.0
#: Entries of the inversion table: P(X > 79) < 1e-45 for a mean of 8, far below the 2**-52 grain of a draw.
TABLE = 80
#: Parts that one row draws at once; about eight times as many copies are exploded at once.
CHUNK = 1_250
#: Up to so many sources the rate table (a few hundred bytes a source) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def uniform(key: Column) -> Column:
    """[0, 1) from the first 52 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(2.0**52)


def source_rates(docs: DataFrame, weights: dict | None, source_col: str, text_col: str,
                 target_chars: int | None) -> DataFrame:
    """(source, rate): expected copies of a document of each source.

    Without ``weights`` every source has the same share. A source that
    ``weights`` omits gets no copies. A source of empty texts only can't be
    brought to a share of characters; its documents are kept at rate 1."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.length(text_or_empty(text_col))).cast("double").alias("chars"))
    if weights is None:
        share = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_source string, weight double")
        share = (sizes.join(F.broadcast(given), F.col("source").cast("string").eqNullSafe(F.col("w_source")), "left")
                 .select("source", "chars",
                         F.when(F.col("chars") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(0.0)).alias("weight")))
    total = share.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars")).first()
    target = float(target_chars if target_chars is not None else total["all_chars"] or 0.0)
    return share.select("source", F.when(F.col("chars") > 0,
                                         F.col("weight") / F.lit(total["all_weight"] or 1.0) * F.lit(target) / F.col("chars"))
                        .otherwise(F.lit(1.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict | None = None, seed: int = 42, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text", target_chars: int | None = None,
                copy_col: str = "copy_no", order_col: str = "shuffle_key", by_text: bool = False) -> DataFrame:
    """All columns of ``docs``, a row per drawn copy, with the copy's number
    (from 1) and its place key, in the global order of that key.

    A null source is a source of its own; a null id draws as the empty text, and
    rows with equal ids draw alike (``by_text``: only those whose texts are equal
    too); null and empty texts have size 0; an empty table gives an empty result.
    Column names of ``docs`` are left as they are (``copy_col`` and ``order_col``
    must not be among them)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if by_text:
        key = F.concat(key, F.lit(":"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")))
    out = _replicated(docs, source_rates(docs, weights, source_col, text_col, target_chars), key, seed, source_col, copy_col)
    place = F.md5(F.concat(F.lit(f"{seed}>"), key, F.lit(":"), F.col(copy_col).cast("string")).cast("binary"))
    return out.withColumn(order_col, place).orderBy(order_col)


def _replicated(docs: DataFrame, rates: DataFrame, key: Column, seed: int, source_col: str, copy_col: str) -> DataFrame:
    """The columns of ``docs`` and the copy's number, a row per drawn copy."""
    r_src, parts, cdf, count = (fresh(docs, n) for n in ("rate_source", "rate_parts", "rate_cdf", "n_copies"))
    n_parts = F.greatest(F.ceil(F.col("rate") / F.lit(STEP)), F.lit(1)).cast("int")
    # cumulative Poisson probabilities of the part's mean: p(0) = exp(-m), p(k) = p(k-1) * m / k
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE - 1)),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c")),
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"),
                                F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * F.col("mean") / k)).alias("c")),
        lambda acc: acc["c"])
    rates = materialize(rates.withColumn(parts, n_parts).withColumn("mean", F.col("rate") / F.col(parts))
                        .select(F.col("source").alias(r_src), parts, table.alias(cdf)), "mix-rates")
    size = rates.agg(F.count(F.lit(1)).alias("n"), F.max(parts).alias("most")).first()

    def met(some: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(some) if size["n"] <= BROADCAST_SOURCES else some, F.col(source_col).eqNullSafe(F.col(r_src)))

    def drawn(first: Column, last: Column, of: Column) -> Column:
        draws = F.transform(F.sequence(first, last), lambda j: uniform(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(":"), of)))
        return F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(cdf), lambda c: c <= u)))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = (met(rates.where(F.col(parts) <= CHUNK), docs)
           .withColumn(count, drawn(F.lit(1), F.col(parts), key)).where(F.col(count) > 0)
           .select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count).cast("bigint"))).alias(copy_col)))
    if (size["most"] or 0) <= CHUNK:
        return out
    # Draws depend on source and key only: a row per chunk of parts, with the copies before it and its own.
    # With a number the partitions aren't merged for being small: the chunks are, what they make isn't.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many, draw = rates.where(F.col(parts) > CHUNK), fresh(docs, "draw_key")
    rows = met(many.select(r_src), docs.withColumn(draw, key)).select(*columns, draw)
    chunks = (met(many, rows.select(F.col(f"`{source_col}`"), draw).distinct())
              .select(F.col(r_src).alias("s"), F.col(draw).alias("k"), cdf, parts,
                      F.explode(F.sequence(F.lit(1), F.col(parts), F.lit(CHUNK))).alias("first"))
              .repartition(tasks, "k", "first")
              .select("s", "k", "first", drawn(F.col("first"), F.least(F.col("first") + F.lit(CHUNK - 1), F.col(parts)), F.col("k"))
                      .cast("bigint").alias("own")))
    chunks = materialize(chunks, "mix-chunks")
    upto = F.sum("own").over(Window.partitionBy("s", "k").orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    spans = chunks.withColumn("upto", upto).where("own > 0").select(
        *[F.col(c).alias(fresh(rows, f"span_{c}")) for c in ("s", "k", "first", "own", "upto")])
    s, k, first, own, upto = spans.columns
    copies = (rows.join(spans, F.col(f"`{source_col}`").eqNullSafe(F.col(s)) & (F.col(draw) == F.col(k)))
              .repartition(tasks, F.col(k), F.col(first))
              .select(*columns, F.explode(F.sequence(F.col(upto) - F.col(own) + F.lit(1), F.col(upto))).alias(copy_col)))
    return out.unionByName(copies)
