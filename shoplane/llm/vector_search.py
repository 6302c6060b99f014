"""Exact top-k search over integer vectors: columnar branch and bound.

Vectors are stored in chunks of up to ``chunk`` rows with their components in vertical layout: all first
components, then all second ones, and so on. A query block's inner products with a chunk are added
up one block of dimensions at a time. After each, Cauchy-Schwarz over the masses (sums of
squares) of the dimensions that remain bounds what a candidate can still reach; those that stay below the
query's k-th best score so far are dropped, and once few are left the survivors are
compacted. The first bounds come from the query block's own vectors, which are rows of the table too.

Queries come in blocks of bounded size; each block is held by every task and scans the chunks once.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shoplane.llm.common import materialize

#: Share of (query, candidate) cells alive below which survivors are compacted query by query.
_COMPACT = 0.25
_QUERIES_AT_ONCE, _CANDIDATES_AT_ONCE = 64, 1024
_EXACT = 2**53


def quantized(column: pa.Array, scale: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, integer components as doubles) for each dimension among the lists of ``column``; lists that
    are null or hold a null or a component that is not finite once multiplied are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.asarray(column.is_valid())
    ends = np.asarray(column.offsets, np.int64)
    flat = np.asarray(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    sizes = np.diff(ends)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * flat)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    there &= bad[ends[1:]] == bad[ends[:-1]]
    out = []
    for dim in np.unique(sizes[there]).tolist():
        rows = np.flatnonzero(there & (sizes == dim))
        out.append((dim, rows, flat[ends[rows][:, None] + np.arange(dim)]))
    return out


def vertical_chunks(vectors: DataFrame, id_col: str, vector_col: str, scale: int, chunk: int) -> DataFrame:
    """(dim, ids, wide, components): chunks of vectors of one dimension, the components dimension by dimension as
    32-bit integers, or as doubles where one needs more."""
    id_type = vectors.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for dim, rows, values in quantized(batch.column(1), scale):
                for lo in range(0, len(rows), chunk):
                    part, ids = values[lo:lo + chunk], batch.column(0).take(pa.array(rows[lo:lo + chunk]))
                    wide = bool(part.size and np.abs(part).max() >= 2**31)
                    data = np.ascontiguousarray(part.T).astype("<f8" if wide else "<i4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.to_pylist()], pa.list_(ids.type)),
                                                      pa.array([wide]), pa.array([data], pa.binary())], names=["dim", "ids", "wide", "components"])

    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("wide", T.BooleanType()), T.StructField("components", T.BinaryType())])
    return vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>")).mapInArrow(run, schema)


def _small(dim: int) -> float:
    """Components below this have inner products that doubles hold."""
    return math.floor(math.sqrt((_EXACT - 1) / max(1, dim)))


def _saturated(x) -> int:
    return max(-2**63, min(2**63 - 1, int(x)))


class _Search:
    """The best candidates of queries of one dimension. ``scan`` takes a chunk's ids and vertical components."""

    def __init__(self, ids: list, queries: np.ndarray, k: int, block: int, least: np.ndarray | None = None):
        self.ids, self.q, self.k, self.block = ids, queries, k, max(1, block)
        self.dim = queries.shape[1]
        self.top: list[list[tuple]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.biggest = float(np.abs(queries).max()) if queries.size else 0.0
        self.mass = self._masses(queries.T) if self._exact(self.biggest) else None

    def _masses(self, vertical: np.ndarray) -> np.ndarray:
        """Sums of squares of the dimensions from each block's start on, a row a block."""
        starts = range(0, self.dim, self.block)
        parts = [np.square(vertical[a:a + self.block]).sum(axis=0) for a in starts] + [np.zeros(vertical.shape[1])]
        return np.cumsum(parts[::-1], axis=0)[::-1]

    def _exact(self, biggest: float) -> bool:
        """Whether every sum of products or squares is a whole number that doubles hold."""
        return max(self.biggest, biggest) < _small(self.dim)

    def seed(self) -> np.ndarray:
        """The k-th best score among the other queries, themselves rows of the table: no candidate below it is among the k best."""
        if len(self.ids) > self.k and self._exact(self.biggest):
            place: dict = {}
            for i, x in enumerate(self.ids):
                place.setdefault(x, []).append(i)
            for lo in range(0, len(self.ids), _QUERIES_AT_ONCE):
                scores = self.q[lo:lo + _QUERIES_AT_ONCE] @ self.q.T
                for i in range(len(scores)):
                    scores[i, place[self.ids[lo + i]]] = -np.inf
                self.least[lo:lo + len(scores)] = np.partition(scores, len(self.ids) - self.k, axis=1)[:, -self.k]
        return self.least

    def scan(self, ids: list, vertical: np.ndarray) -> None:
        for lo in range(0, len(ids), _CANDIDATES_AT_ONCE):
            part = np.ascontiguousarray(vertical[:, lo:lo + _CANDIDATES_AT_ONCE], np.float64)
            self._scan(ids[lo:lo + _CANDIDATES_AT_ONCE], part)

    def _scan(self, ids: list, vertical: np.ndarray) -> None:
        if vertical.size and not self._exact(float(np.abs(vertical).max())):
            large = np.abs(vertical).max(axis=0) >= _small(self.dim)
            if self.biggest < _small(self.dim) and not large.all():
                for part in (~large, large):
                    self._scan([ids[j] for j in np.flatnonzero(part)], np.ascontiguousarray(vertical[:, part]))
                return
            whole = [[int(x) for x in row] for row in vertical.T.tolist()]
            for i, q in enumerate(self.q.tolist()):
                q = [int(x) for x in q]
                self._offer(i, ids, range(len(ids)), [_saturated(sum(a * b for a, b in zip(q, c))) for c in whole])
            return
        mass = self._masses(vertical)
        for lo in range(0, len(self.ids), _QUERIES_AT_ONCE):
            self._tile(range(lo, min(lo + _QUERIES_AT_ONCE, len(self.ids))), ids, vertical, mass)

    def _tile(self, queries: range, ids: list, vertical: np.ndarray, mass: np.ndarray) -> None:
        q, least = self.q[queries.start:queries.stop], self.least[queries.start:queries.stop, None]
        total, alive = np.zeros((len(queries), len(ids))), np.ones((len(queries), len(ids)), bool)
        blocks = list(enumerate(range(0, self.dim, self.block), 1))
        while blocks and alive.mean() > _COMPACT:  # the whole tile at once while most of it lives
            b, a = blocks.pop(0)
            total += q[:, a:a + self.block] @ vertical[a:a + self.block]
            alive = total + self._rest(self.mass[b, queries.start:queries.stop, None], mass[b]) >= least
        for i, row in zip(queries, range(len(queries))):
            at = np.flatnonzero(alive[row])
            sums = total[row, at]
            for b, a in blocks:  # the survivors, compacted again after every block
                if not len(at):
                    break
                sums = sums + self.q[i, a:a + self.block] @ vertical[a:a + self.block, at]
                left = sums + self._rest(self.mass[b, i], mass[b, at]) >= self.least[i]
                at, sums = at[left], sums[left]
            if len(at):
                self._offer(i, ids, at.tolist(), sums.tolist())

    @staticmethod
    def _rest(a, b):
        """What the remaining dimensions can add at most, rounded up."""
        return np.ceil(np.sqrt(a * b) * (1 + 1e-12)) + np.where(a * b > 0, 1, 0)

    def _offer(self, i: int, ids: list, at, scores) -> None:
        own, top = self.ids[i], self.top[i]
        top += [(-int(s), ids[j] is None, ids[j]) for j, s in zip(at, scores) if ids[j] != own and s >= self.least[i]]
        if len(top) >= self.k:
            top.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
            del top[self.k:]
            self.least[i] = max(self.least[i], -top[-1][0])

    def best(self):
        return [(self.ids[i], c, -s) for i, top in enumerate(self.top) for s, _, c in top]


def _search_block(spark, chunks: DataFrame, queries: list, k: int, block: int, id_type) -> DataFrame:
    """(query_id, vec_id, score): each task's best candidates of one block's queries."""
    kind = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.LongType())])

    parts = []
    for dim, ids, q in queries:  # queries that need larger numbers than doubles apart from the others
        large = np.abs(q).max(axis=1, initial=0) >= _small(dim)
        for some in (~large, large):
            own = [ids[j] for j in np.flatnonzero(some)]
            if own:
                parts.append((dim, own, q[some], _Search(own, q[some], k, block).seed()))

    def run(batches):
        searches = [_Search(ids, q, k, block, least) for _, ids, q, least in parts]
        for batch in batches:
            for dim, ids, wide, data in zip(*batch.columns):
                ids = ids.as_py()
                vertical = np.frombuffer(data.as_py(), "<f8" if wide.as_py() else "<i4").reshape(-1, len(ids))
                for search in searches:
                    if search.dim == dim.as_py():
                        search.scan(ids, vertical)
        best = [x for s in searches for x in s.best()]
        if best:
            q, c, s = zip(*best)
            yield pa.RecordBatch.from_arrays([pa.array(q, kind), pa.array(c, kind), pa.array(s, pa.int64())], names=schema.names)

    return chunks.mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
          dim_block: int = 8, chunk: int = 4096, block_queries: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of greatest integer inner product with every query, best first,
    equal scores by ascending id (null ids last).

    Queries are the rows where the SQL condition ``is_query`` holds; candidates are all rows of another id.
    Components become floor(scale * x) as doubles. Vectors that are null, or that hold a null or a component that
    is not finite (or not once scaled), take no part; only vectors of the same length meet, and empty vectors score 0. Equal
    query rows are one query; different vectors of one query id share its ranks. Repeated candidates rank side by
    side. Scores beyond 64 bits are cut to the nearest 64-bit integer. Extra columns are ignored; an empty table gives an empty result.

    Queries are read in blocks of about ``block_queries``, dealt by a hash, and each block's results are stored before the next."""
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    chunks = materialize(vertical_chunks(rows, "vec_id", "v", scale, chunk), "vector-chunks")
    queries = vectors.where(is_query).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).distinct()
    queries = materialize(queries, "vector-queries")
    n_blocks = max(1, -(-queries.count() // block_queries))
    found = []
    for i in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)) == i).toArrow()
        block = [(dim, part.column(0).take(pa.array(at)).to_pylist(), values) for dim, at, values in quantized(part.column(1), scale)] if len(part) else []
        found.append(materialize(_search_block(spark, chunks, block, k, dim_block, id_type), "vector-best"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return (reduce(DataFrame.unionByName, found).withColumn("rank", place).where(f"rank <= {k}")
            .select("query_id", "rank", F.col("vec_id").alias(id_col), "score"))
