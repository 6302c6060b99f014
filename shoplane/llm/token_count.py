"""Token counts: batch encoding in Arrow functions that return lengths only.

Each Arrow batch is cut into groups of about ``batch_bytes`` of text. Within a
group every text is split at boundaries the pre-tokenizer always breaks at (the
position before a space that a non-space follows), so a long text never becomes
one huge encoding. Equal units are encoded once per worker.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.llm.common import tokenizer_file, worker_state

#: A space before which a cut would not be safe: white space or the end follows.
_UNSAFE = re.compile(r" (?=\s|$)")
_SAFE_CUT = re.compile(r"(?= \S)")


def byte_groups(sizes: list[int], batch_bytes: int):
    """Consecutive index ranges of about ``batch_bytes`` each."""
    lo = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= batch_bytes:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


class UnitCounter:
    """Token counts of texts from the counts of their safe units."""

    def __init__(self, path: str, max_units: int, max_unit_chars: int = 64):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file(path))
        self.max_units, self.max_unit_chars = max_units, max_unit_chars
        # two generations: units in use are in the first or move there; when it is full it becomes the second
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _encode(self, units: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        split = [re.split(_SAFE_CUT, t) if _UNSAFE.search(t) else _spaced(t) for t in texts]
        if len(self.known) > self.max_units // 2:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        missing = {u for units in split for u in units if u not in known}
        known.update((u, old[u]) for u in missing & old.keys())
        missing = list(missing - old.keys())
        missing.sort(key=len)  # encoded beside units of like length
        for lo in range(0, len(missing), 4096):
            part = missing[lo:lo + 4096]
            known.update(zip(part, self._encode(part)))
        out = [sum(map(known.__getitem__, units)) for units in split]
        for u in reversed(missing):
            if len(u) <= self.max_unit_chars:
                break
            del known[u]
        return out


def _spaced(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *(" " + r for r in rest)]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, batch_bytes: int = 1 << 20, max_units: int = 800_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Null and empty texts count 0 tokens; repeated rows are counted each; extra
    columns are ignored; an empty table gives an empty result."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        state = worker_state("token_count")
        key = f"unit_counter:{tokenizer_path}"
        if key not in state:
            state[key] = UnitCounter(tokenizer_path, max_units)
        counter = state[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            counts: list[int] = []
            for lo, hi in byte_groups(sizes, batch_bytes):
                counts += counter.counts(texts[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    return (docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
