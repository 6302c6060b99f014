"""Token-id output: texts encoded, written as segments of directly addressable
codes in ascending id order, and read back.

A token file set is a folder of Parquet files. A row is a segment: its place
(``part``, ``seg``), the ids and token counts of the documents in it, and the
payload of ``dac.encode``. Segments end at document boundaries once they hold
``segment_tokens`` ids. Parts are the ranges of a range partitioning by id, so
(part, seg) is the global order; global positions come from the prefix sums of
the parts' and segments' sizes, which are the only things summed across files.
"""

from __future__ import annotations

import gc
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.llm import dac
from shoplane.llm.common import tokenizer_file, worker_state
from shoplane.llm.token_count import byte_groups

#: Text encoded at once.
_GROUP_BYTES = 1 << 20


class _Words:
    """Token ids of words: word -> place, and each place's run in one array of ids."""

    #: Bytes of a dictionary slot, a key's head and a place.
    ENTRY = 190

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.starts, self.ids, self.used, self.held = np.zeros(1025, np.int64), np.zeros(4096, "<u4"), 0, 0

    def add(self, words: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        n, end = len(self.place), len(self.place) + len(words)
        while end >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[n + 1:end + 1] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.place.update(zip(words, range(n, end)))
        self.held += self.ENTRY * len(words) + sum(map(len, words)) + 4 * len(ids)

    def runs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of ``places``, ids in one array."""
        counts = self.starts[places + 1] - self.starts[places]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return counts, self.ids[np.repeat(self.starts[places] - ends + counts, counts) + np.arange(total)]


#: A plain word (lower-case Latin letters after lower-casing) and trailing punctuation: each becomes one pre-token.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,!*$%&#;:?]*)")


class WordEncoder:
    """Token ids of texts from the ids of their words.

    The vocabulary's pre-tokenizer drops white space and never joins across it,
    so a text's ids are its white-space separated words' ids in order. The tokenizers library encodes
    plain words many at a time, with the vocabulary's merges alone, cut apart again at the end-of-word marks; others go through all
    its steps one by one. Their ids stay in a table of two generations of ``max_bytes`` together (and one batch's words):
    words in use are in the young one, or move there; when that is full it becomes the old one, and what the old one still held goes."""

    def __init__(self, path: str, max_bytes: int):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core already
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.max_bytes = Tokenizer.from_file(tokenizer_file(path)), max_bytes
        self.young, self.old = _Words(), _Words()
        model = json.loads(self.tokenizer.to_str())
        mark = model["model"].get("end_of_word_suffix")
        self.lowers = "Lowercase" in json.dumps(model.get("normalizer"))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = None
        if mark and self.lowers and "ByteLevel" in json.dumps(model.get("pre_tokenizer")):
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(mark)]] = True
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _each(self, words: list[str]) -> tuple[list[int], list[np.ndarray]]:
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return list(map(len, ids)), ids

    def _plain(self, words: list[str]) -> tuple[list[int], list[np.ndarray]]:
        """(counts, ids) of lower-case words of letters."""
        counts, ids = [], []
        groups = [words[k:k + 64] for k in range(0, len(words), 64)]
        for group, e in zip(groups, self.merges.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            found = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[found])
            if len(ends) == len(group):
                counts += np.diff(ends, prepend=-1).tolist()
                ids.append(found)
            else:  # a marked token inside a word: one by one
                one, each = self._each(group)
                counts += one
                ids += each
        return counts, ids

    def _encode(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words in another order, counts, ids)."""
        plain, odd = [], []
        for w in words:
            m = _PLAIN.fullmatch(w.decode().lower()) if self.ends is not None else None
            (plain.append((w, m[1], m[2])) if m else odd.append(w))
        parts, bases, tails = _Words(), list({p[1] for p in plain}), list({p[2] for p in plain})
        counts, ids = self._plain(bases)
        more, tail_ids = self._each(tails)
        parts.add(bases + tails, np.array(counts + more, np.int64), np.concatenate([*ids, *tail_ids, np.empty(0, "<u4")]))
        place = np.array([parts.place[x] for _, base, tail in plain for x in (base, tail)], np.int64)
        counts, ids = parts.runs(place)
        more, odd_ids = self._each([w.decode() for w in odd])
        return ([p[0] for p in plain] + odd, np.concatenate([counts.reshape(-1, 2).sum(axis=1), np.array(more, np.int64)]),
                np.concatenate([ids, *odd_ids]))

    def _need(self, words: list[bytes]) -> None:
        """Put words into the young generation: from the old one, or encoded."""
        again = [w for w in words if w in self.old.place]
        if again:
            self.young.add(again, *self.old.runs(np.array([self.old.place[w] for w in again])))
        new = [w for w in words if w not in self.old.place]
        if new:
            self.young.add(*self._encode(new))

    def _folded(self, text: bytes) -> bytes:
        """The text with A-Z in lower case where the vocabulary does no more than that to them: not before combining marks, with which
        letters are composed first (their UTF-8 begins with CC or CD), nor where an added token would come about."""
        low = text.lower()
        return text if b"\xcc" in text or b"\xcd" in text or any(a in low for a in self.added) else low

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text."""
        gc.disable()  # nothing here makes cycles, and the collector would walk the tables again and again
        try:
            return self._ids_of([self._folded(t) for t in texts] if self.lowers else texts)
        finally:
            gc.enable()

    def _ids_of(self, texts: list[bytes]) -> list[bytes]:
        if self.young.held > self.max_bytes // 2:
            self.young, self.old = _Words(), self.young
        split = [t.split() for t in texts]  # bytes: ASCII white space only
        words = list(chain.from_iterable(split))
        places = np.fromiter(map(self.young.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(places < 0).tolist()
        if missing:
            self._need(list({words[i] for i in missing}))
            places[missing] = [self.young.place[words[i]] for i in missing]
        counts, ids = self.young.runs(places)
        cuts = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)] * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id",
                      text_col: str = "text", segment_tokens: int = 1 << 18, max_bytes: int = 192 << 20) -> None:
    """Encode every row of ``docs`` (null: empty text), append ``end_id`` to each
    and write the segments under ``path``, in ascending id order (null ids first,
    ties by text). Repeated rows are each written; an empty table writes no
    segment; extra columns are ignored."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        from pyspark import TaskContext
        state = worker_state("token_file")
        key = f"word_encoder:{tokenizer_path}"
        if key not in state:
            state[key] = WordEncoder(tokenizer_path, max_bytes)
        encoder, part, seg = state[key], TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids, counts, codes, held = [], [], [], 0

        def segment():
            payload = dac.encode(np.frombuffer(b"".join(codes), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([held], pa.int64()),
                 pa.array([ids], pa.list_(id_arrow)), pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "seg", "n_tokens", "doc_ids", "doc_tokens", "payload"])

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            texts = batch.column(1).cast(pa.binary())
            for lo, hi in byte_groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), _GROUP_BYTES):
                some = [t.as_py() or b"" for t in texts[lo:hi]]
                for doc_id, code in zip(batch.column(0)[lo:hi].to_pylist(), encoder.encode(some)):
                    ids.append(doc_id)
                    codes.append(code + end)
                    counts.append(len(code) // 4 + 1)
                    held += counts[-1]
                    if held >= segment_tokens:
                        yield segment()
                        ids, counts, codes, held, seg = [], [], [], 0, seg + 1
        if ids:
            yield segment()

    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("doc_tokens", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType())])
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    # equal ids are told apart by their texts, equal rows by their place in the input, so a hot id spreads over ranges
    rows = rows.withColumn("tie", F.xxhash64("t")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("i", "tie", "row").sortWithinPartitions("i", "tie", "row")
    ordered.select("i", "t").mapInArrow(run, schema).write.parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seg, start): ids before each segment. Windows run within a part,
    and over one row a part for the parts' totals."""
    sizes = read_segments(spark, path).select("part", "seg", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    return (sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, F.col("part") == F.col("p"))
            .select("part", "seg", (F.col("base") + F.col("inside")).alias("start")))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the files.
    ``start`` counts the ids of all documents before it."""
    segments = read_segments(spark, path)
    id_type = segments.schema["doc_ids"].dataType.elementType

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = dac.Segment(row["payload"]).all().astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - np.array(row["doc_tokens"])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seg"]] * n, pa.int32()),
                     pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(starts, pa.int64()),
                     pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "seg", "id", "inside", "n_tokens", "ids_crc32"])

    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField("id", id_type),
        T.StructField("inside", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    docs = segments.select("part", "seg", "doc_ids", "doc_tokens", "payload").mapInArrow(run, schema)
    return (docs.join(segment_starts(spark, path), ["part", "seg"])
            .select(F.col("id").alias(id_col), (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def read_tokens(spark: SparkSession, path: str, positions: DataFrame, position_col: str = "position",
                bucket: int = 1 << 18) -> DataFrame:
    """(position, token) for each distinct global position that exists: segments
    and positions meet on the ``bucket`` that holds them; tokens are read one by
    one from the codes, without decoding the segment."""
    segments = (read_segments(spark, path).select("part", "seg", "n_tokens", "payload")
                .join(segment_starts(spark, path), ["part", "seg"]).where("n_tokens > 0")
                .withColumn("bucket", F.explode(F.expr(f"sequence(start div {bucket}, (start + n_tokens - 1) div {bucket})"))))
    wanted = (positions.select(F.col(position_col).cast("bigint").alias("position")).where("position >= 0").distinct()
              .withColumn("bucket", F.expr(f"position div {bucket}")))

    def run(key, left, right):
        import pandas as pd
        found = []
        for start, n, payload in zip(right["start"], right["n_tokens"], right["payload"]):
            segment = dac.Segment(payload)
            inside = left["position"][(left["position"] >= start) & (left["position"] < start + n)]
            found += [(p, segment.token(p - start)) for p in inside]
        return pd.DataFrame(found, columns=["position", "token"])

    return wanted.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInPandas(run, "position bigint, token bigint")
