"""Ranked lexical search: the best documents of every item, by bag deduplication.

Documents are restricted to the items' vocabulary: of a text there remain its term
count and a vector of (term, occurrences). Documents with the same length
weight and the same vector are one class: whatever the item, they score alike.
A class is scored once, and its members are put in by ascending id; as only the
first ``k`` of them can be among an item's ``k`` best, each class carries that many.

Items come in blocks of bounded size, each block held by every task; the scores of a
block's items for a batch of classes are one product of two small matrices, in
numbers that doubles hold exactly.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shoplane.llm.common import materialize, worker_state

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between terms; a term is a maximal run of anything else.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 bytes with the ones between terms as spaces and A-Z in lower case.
_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
#: Terms that so many documents hold are multiplied as a dense matrix; the others one by one.
_DENSE_TERMS, _CLASSES_AT_ONCE = 512, 256


def terms(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def term_column(text: Column) -> Column:
    """The terms of a text, one row each, by SQL functions."""
    return F.explode(F.filter(F.split(F.translate(text, _UPPER, _LOWER), BETWEEN), lambda t: t != ""))


def impact(tf, m):
    return (10**9 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _vocabulary(key: str, words: list[bytes]) -> dict[bytes, int]:
    state = worker_state("lexical")
    if state.get("lexical_key") != key:
        state["lexical_key"], state["lexical"] = key, {w: i for i, w in enumerate(words)}
    return state["lexical"]


def item_vectors(docs: DataFrame, words: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, vec) of every document with a term: n terms in all, and the (place in ``words``, occurrences)
    of those in ``words`` as ascending pairs of little-endian unsigned 32-bit numbers."""
    key = uuid.uuid4().hex

    def run(batches):
        vocabulary = _vocabulary(key, words)
        known = vocabulary.keys()
        for batch in batches:
            at, counts, vectors = [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                found = terms(text.as_py() or b"")
                if found:
                    bag = Counter(found)
                    pairs = sorted((vocabulary[w], bag[w]) for w in bag.keys() & known)
                    at.append(i)
                    counts.append(len(found))
                    vectors.append(array("I", [x for p in pairs for x in p]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(counts, pa.int64()),
                                              pa.array(vectors, pa.binary())], names=["id", "n", "vec"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
                           T.StructField("vec", T.BinaryType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def document_frequencies(vectors: DataFrame, n_words: int) -> DataFrame:
    """(term, df) of the terms that occur; each task adds up its own rows first."""
    def run(batches):
        df = np.zeros(n_words, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                flat = np.frombuffer(b"".join(batch.column(0)[lo:lo + 1024].to_pylist()), "<u4")
                df += np.bincount(flat[::2], minlength=n_words)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    return vectors.select("vec").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def classes(vectors: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, vec, members): documents of one length weight and one vector, with the ``k`` smallest ids (null last).
    Rows meet by a hash and are told apart by the weight and vector themselves; each task sends at most
    ``k`` rows of a class on."""
    m = F.expr(f"25 + (75 * n * {n_docs}L) div {n_terms}L")
    rows = vectors.where(F.length("vec") > 0).select("id", m.alias("m"), "vec").withColumn("h", F.xxhash64("m", "vec"))
    place = F.row_number().over(Window.partitionBy("h", "m", "vec").orderBy(F.col("id").asc_nulls_last()))
    return (rows.withColumn("place", place).where(f"place <= {k}")
            .groupBy("h", "m", "vec").agg(F.collect_list(F.struct("id")).alias("members")).drop("h"))


class _Scorer:
    """Scores of one block of items; ``offer`` takes classes, ``best`` has (item place, id, score)."""

    def __init__(self, n_items: int, n_words: int, pairs, weights, df, k: int):
        self.k, self.n_items = k, n_items
        item, term, count = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([], [], [])))
        value = weights[term] * count
        # an impact is below 10**6; where sums may leave what a double holds exactly, integers are used
        sums = [0] * n_items
        for i, v in zip(item.tolist(), value.tolist()):
            sums[i] += v
        self.kind = np.float64 if max(sums, default=0) < 2**53 // 10**6 else np.int64
        dense = np.sort(np.argsort(-df, kind="stable")[:_DENSE_TERMS])
        self.place = np.full(n_words, -1, np.int64)
        self.place[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), n_items), self.kind)
        is_dense = self.place[term] >= 0
        np.add.at(self.dense, (self.place[term[is_dense]], item[is_dense]), value[is_dense].astype(self.kind))
        # the others by term: items[start[t]:start[t + 1]] with their values
        term, item, value = term[~is_dense], item[~is_dense], value[~is_dense]
        order = np.argsort(term, kind="stable")
        self.items, self.values = item[order], value[order].astype(self.kind)
        self.start = np.searchsorted(term[order], np.arange(n_words + 1))
        self.top: list[list[tuple]] = [[] for _ in range(n_items)]
        self.least = np.zeros(n_items, self.kind)

    def scores(self, m: np.ndarray, vectors: list[bytes]) -> np.ndarray:
        flat = np.frombuffer(b"".join(vectors), "<u4").reshape(-1, 2).astype(np.int64)
        row = np.repeat(np.arange(len(vectors)), [len(v) // 8 for v in vectors])
        value = impact(flat[:, 1], m[row]).astype(self.kind)
        place = self.place[flat[:, 0]]
        is_dense = place >= 0
        x = np.zeros((len(vectors), len(self.dense)), self.kind)
        x[row[is_dense], place[is_dense]] = value[is_dense]
        out = x @ self.dense
        term, row, value = flat[~is_dense, 0], row[~is_dense], value[~is_dense]
        times = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
        cell, value = np.repeat(row, times) * self.n_items + self.items[at], np.repeat(value, times) * self.values[at]
        if self.kind is np.float64:
            return out + np.bincount(cell, value, out.size).reshape(out.shape)
        np.add.at(out.reshape(-1), cell, value)
        return out

    def offer(self, m: np.ndarray, vectors: list[bytes], members) -> None:
        scores = self.scores(m, vectors)
        if len(vectors) >= self.k:  # so many classes hold so many documents at least
            self.least = np.maximum(self.least, np.partition(scores, len(vectors) - self.k, axis=0)[-self.k])
        ids: dict[int, list] = {}
        touched: set[int] = set()
        for r, j in np.argwhere((scores >= self.least) & (scores > 0)).tolist():
            if r not in ids:
                ids[r] = [(x["id"] is None, x["id"]) for x in members[r].as_py()]
            s = int(scores[r, j])
            self.top[j] += [(-s, *i) for i in ids[r]]
            touched.add(j)
        for j in touched:
            self._cut(j)

    def _cut(self, j: int) -> None:
        top = self.top[j]
        if len(top) > self.k:
            top.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
            del top[self.k:]
        if len(top) == self.k:
            self.least[j] = max(self.least[j], -max(x[0] for x in top))

    def best(self):
        return [(j, i, -s) for j, top in enumerate(self.top) for s, _, i in top]


def _block(docs: DataFrame, rows: list, k: int, id_col: str, text_col: str, item_type) -> DataFrame:
    """(item_id, doc_id, score): each task's best documents of the items of one block."""
    spark, item_kind = docs.sparkSession, to_arrow_type(item_type)
    words = sorted({r["term"].encode() for r in rows})
    place = {w: i for i, w in enumerate(words)}
    items = list(dict.fromkeys(r["item_id"] for r in rows))
    item_place = {x: i for i, x in enumerate(items)}
    pairs = [(item_place[r["item_id"]], place[r["term"].encode()], r["count"]) for r in rows]
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("score", T.LongType())])
    if not rows:
        return spark.createDataFrame([], schema)
    vectors = materialize(item_vectors(docs, words, id_col, text_col), "lexical-vectors")
    total = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    df = np.zeros(len(words), np.int64)
    for r in document_frequencies(vectors, len(words)).collect():
        df[r["term"]] = r["df"]
    weights = np.array([weight(total["n"], int(d)) if d else 0 for d in df], np.int64)
    if not total["n"]:
        return spark.createDataFrame([], schema)

    def run(batches):
        scorer, kind = _Scorer(len(items), len(words), pairs, weights, df, k), None
        for batch in batches:
            m, vectors, members = (batch.column(i) for i in range(3))
            kind = members.type.value_type.field(0).type
            for lo in range(0, batch.num_rows, _CLASSES_AT_ONCE):
                part = slice(lo, lo + _CLASSES_AT_ONCE)
                scorer.offer(m[part].to_numpy(), vectors[part].to_pylist(), members[part])
        best = scorer.best()
        if best:
            at, ids, scores = zip(*best)
            yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in at], item_kind), pa.array(ids, kind), pa.array(scores, pa.int64())],
                                             names=schema.names)

    return materialize(classes(vectors, total["n"], total["l"], k).mapInArrow(run, schema), "lexical-best")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", block_pairs: int = 1 << 18, block_items: int = 4096) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 of every item, best first,
    equal scores by ascending id (null ids last).

    N documents have a term, L terms in all. A term held by df documents weighs floor(1000 * ln((2N+2) / (2df+1))); a document of n
    terms has m = 25 + (75 n N) div L, and its score adds weight * ((10**9 tf) div (1000 tf + 8 m)) for the item's
    terms, repeats included. Null and empty texts have no terms. Rows of one item id are one item, with the terms
    of all; every document row ranks on its own, repeated ones side by side. Items without a term or a match have no rows; extra
    columns are ignored; an empty table gives an empty result.

    Items are read in blocks of about ``block_pairs`` (item, term) pairs and ``block_items`` items, dealt by hash; the documents are read
    once a block."""
    item_type = items.schema[item_col].dataType
    pairs = materialize(items.select(F.col(item_col).alias("item_id"), term_column(F.col(text_col)).alias("term"))
                        .groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("count")), "lexical-items")
    size = pairs.agg(F.count(F.lit(1)), F.count_distinct(F.struct("item_id"))).first()
    n_blocks = max(1, -(-size[0] // block_pairs), -(-size[1] // block_items))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    parts = [_block(docs, pairs.where(block == i).orderBy("item_id", "term").collect(), k, id_col, text_col, item_type) for i in range(n_blocks)]
    best = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", place).where(f"rank <= {k}").select("item_id", "rank", F.col("doc_id").alias(id_col), "score")
