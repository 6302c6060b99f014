"""SimHash near-duplicates: pigeonhole blocks, then the Hamming distance.

Fingerprints of 64 bits are split into ``blocks`` parts. Two fingerprints that
differ in at most ``max_bits`` bits agree in at least ``blocks - max_bits`` of
them, so every such pair shares one of the keys formed by that many blocks
(6 blocks, 3 bits: 20 keys of about 32 bits, so few chance meetings).

Within a key no pairs are enumerated wholesale: first each member is compared
with one centre (the fingerprint of most rows), which contracts groups of copies;
then only the keys whose members still lie in different classes are joined with
themselves, for pairs of different classes; large ones are keyed once more by their other
bits and dealt over a grid, so that no task has more than a small cell of them. No link is lost, and the rows made
stay near the number of fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.llm.common import fresh, materialize
from shoplane.llm.components import connected_components

BITS = 64
#: Members of a key that meet in one place; the pairs of more are split by further bits, then over a grid.
CELL = 256
#: Shingles hashed at once (bounds memory for very long texts).
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, ngram: int, seed: int, digest) -> int:
    """Unsigned fingerprint of one UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: A-Z only; splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < ngram:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(sizes + 1) - 1
        starts = (stop - sizes)[:len(words) - ngram + 1].tolist()
        ends = stop[ngram - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo:lo + _CHUNK], ends[lo:lo + _CHUNK])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3,
                 seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long. Null, empty and
    wordless texts have fingerprint 0."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        from xxhash import xxh64_intdigest
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), ngram, seed, xxh64_intdigest) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Signed 64-bit masks, one per choice of the blocks that must agree."""
    if blocks <= max_bits:
        raise ValueError("pigeonhole needs more blocks than differing bits")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(masks, blocks - max_bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def _keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
                     for i, m in enumerate(masks)])
    return nodes.withColumn("key", F.explode(keys)).select("*", "key.k", "key.v").drop("key")


def _close(a: str, b: str, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _inner_masks(mask: int, max_bits: int, blocks: int) -> list[int]:
    """Masks of the bits outside ``mask``, by which fingerprints that agree on ``mask`` are keyed once more."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in free[cuts[i]:cuts[i + 1]]) for i in range(blocks)]
    return [_signed(sum(c)) for c in combinations(parts, blocks - max_bits)]


def _cells(open_keys: DataFrame, masks: list[int], max_bits: int, blocks: int) -> DataFrame:
    """(k, v, j, u, fp, cls): the members of small keys as they are (j = -1), those of large ones under a second level of
    pigeonhole keys over their other bits: a close pair shares one of these too."""
    inner = [_inner_masks(m, max_bits, blocks) for m in masks]
    flat, each = F.array(*[F.lit(m) for ms in inner for m in ms]), len(inner[0])
    columns = ["k", "v", "j", "u", "fp", "cls"]
    small = open_keys.where(F.col("size") <= CELL).withColumn("j", F.lit(-1)).withColumn("u", F.lit(0).cast("long")).select(columns)
    large = open_keys.where(F.col("size") > CELL).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    mask = F.element_at(flat, F.col("k").cast("int") * each + F.col("j") + 1)
    return small.unionByName(large.withColumn("u", F.col("fp").bitwiseAND(mask)).select(columns))


def _dealt(cells: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """``cells`` with a place in a grid: the members of a group that is still large are cut by hash into parts, and each part
    meets every part of the other side in a cell of its own."""
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = cells.join(sizes, ["k", "v", "j", "u"], "left").withColumn(own, F.pmod(F.xxhash64("fp"), parts).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")


def link_fingerprints(nodes: DataFrame, max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """(node, root) of every linked fingerprint but the roots; ``nodes`` has
    distinct longs ``fp`` and their number of rows ``n``."""
    masks = block_masks(blocks, max_bits)
    keyed = _keyed(nodes.select("fp", "n"), masks)
    shared = (keyed.groupBy("k", "v").agg(F.max_by("fp", F.struct("n", "fp")).alias("centre"), F.count(F.lit(1)).alias("members"))
              .where("members > 1").drop("members"))
    members = materialize(keyed.join(shared, ["k", "v"]).select("k", "v", "fp", "centre"), "simhash-members")
    stars = members.where((F.col("fp") != F.col("centre")) & _close("fp", "centre", max_bits))
    first = connected_components(stars.select(F.col("fp").alias("a"), F.col("centre").alias("b")))
    classed = (members.select("k", "v", "fp").join(first, members["fp"] == first["node"], "left")
               .select("k", "v", "fp", F.coalesce("root", "fp").alias("cls")))
    mixed = classed.groupBy("k", "v").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 <> c1")
    open_keys = classed.join(mixed.select("k", "v", "size"), ["k", "v"])
    cells = materialize(_cells(open_keys, masks, max_bits, blocks), "simhash-open")
    sizes = cells.groupBy("k", "v", "j", "u").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("parts")).where("parts > 1")
    a, b = _dealt(cells, sizes, "x", "y").alias("a"), _dealt(cells, sizes, "y", "x").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("k", "v", "j", "u", "x", "y")]
    pairs = a.join(b, [*same, (F.col("a.cls") < F.col("b.cls")) & _close("a.fp", "b.fp", max_bits)])
    second = connected_components(pairs.select(F.col("b.cls").alias("a"), F.col("a.cls").alias("b")).distinct())
    # a class that the second round merged points at the merged class's root
    moved = second.select(F.col("node").alias("cls"), F.col("root").alias("to"))
    roots = (first.join(moved, first["root"] == moved["cls"], "left")
             .select("node", F.coalesce("to", "root").alias("root")))
    return materialize(roots.unionByName(second), "simhash-roots")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, seed: int = 42,
                       max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``: 16 lowercase
    hex digits, and the smallest id reachable over links of at most ``max_bits``
    differing bits (its own included).

    Null, empty and wordless texts share fingerprint 0 and are linked like any
    other. Null ids never name a component unless it has no other (then NULL).
    Repeated rows each get a row. Extra columns are ignored."""
    per_row = materialize(fingerprints(docs, id_col, text_col, ngram, seed), "simhash-rows")
    component = _lowest(per_row, max_bits, blocks)
    return (per_row.join(component, per_row["fp"] == component["c_fp"], "left")
            .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def _lowest(per_row: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """(c_fp, component_id): every fingerprint of ``per_row`` (id, fp) and the smallest id of its component."""
    nodes = materialize(per_row.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = link_fingerprints(nodes, max_bits, blocks)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(lowest, "root").select(F.col("fp").alias("c_fp"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, seed: int = 42,
                         max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """The columns of ``docs``, one row of each component: the one of the smallest
    id, ties by the text's MD5, null ids last. Rows are told apart by id and text,
    so other texts of a repeated or null id stay or go with their own component;
    of rows equal in both any one stays."""
    key, kept = fresh(docs, "row_key"), fresh(docs, "kept_key")
    row_key = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("h"))
    keyed = docs.withColumn(key, row_key)
    per_row = materialize(fingerprints(keyed, key, text_col, ngram, seed), "simhash-rows")
    names = _lowest(per_row, max_bits, blocks).select(F.col("component_id").alias(kept)).distinct()
    # structs are equal where their nulls are; equal keys have equal texts, so one component
    rows = keyed.join(names, F.col(key) == F.col(kept), "left_semi")
    return rows.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
