"""Order statistics by radix selection (A5, O2, O3): the value at a rank without a sort,
a window over the rows or a join of them.

Every order component has an order-preserving 64-bit key. A pass counts the rows of
the wanted key range by their next 16 bits (one hash aggregate with
map-side partial sums, so a value that a third of the rows share is one row a task), keeps the bucket
that holds the rank together with the least and greatest key in it, and goes on
inside: four passes at most a component, fewer where the keys are close together.

Over the whole table the bounds are literals in the next pass's filter, and at most
2**16 counts a rank reach the driver. Per group the bounds are a table of one row a group, joined
to the rows null-safely (broadcast only behind its measured size).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.operators.schema import col

DIGIT_BITS = 16
_NORMAL, _SUBNORMAL, _MAX = 2.0 ** -1022, 2.0 ** -1074, 1.7976931348623157e308
_ALL = (-2**63, 2**63 - 1)
#: Bytes of a text that one key holds, beside the number of bytes that were there.
_TEXT_BYTES = 6


def double_key(x: Column) -> Column:
    """Order-preserving 64-bit key of a double without NaN: the bits of its magnitude (exponent and mantissa, taken
    apart by exact scaling with powers of two), negated for negative numbers. -0.0 and 0.0 share a key."""
    a = F.abs(x)
    scaled = F.greatest(F.least(a, F.lit(_MAX)), F.lit(_NORMAL))
    guess = F.greatest(F.least(F.floor(F.log2(scaled)), F.lit(1023)), F.lit(-1022))  # off by one at most
    m = scaled / F.pow(F.lit(2.0), guess)
    e = F.when(m >= 2, guess + 1).when(m < 1, guess - 1).otherwise(guess)
    mantissa = ((scaled / F.pow(F.lit(2.0), e) - 1) * F.lit(2.0 ** 52)).cast("long")
    bits = (F.when(a > _MAX, F.lit(2047 << 52)).when(a >= _NORMAL, (e + 1023) * F.lit(1 << 52) + mantissa)
            .otherwise((F.least(a, F.lit(_NORMAL)) / F.lit(_SUBNORMAL)).cast("long")))
    return F.when(x < 0, -bits).otherwise(bits)


def double_of_key(key: int) -> float:
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def key_of_double(value: float) -> int:
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def _text_key(x: Column, level: int) -> Column:
    """Key of the ``level``-th piece of a text's UTF-8 bytes: the bytes, filled up with zeros, then how many there were."""
    piece = F.encode(x, "UTF-8").substr(F.lit(1 + level * _TEXT_BYTES), F.lit(_TEXT_BYTES))
    digits = F.rpad(F.hex(piece), 2 * _TEXT_BYTES, "0")
    return F.conv(digits, 16, 10).cast("long") * 8 + F.octet_length(piece)


def _key(component: Column, kind: str, level: int) -> Column:
    return component if kind == "int" else double_key(component) if kind == "float" else _text_key(component, level)


def _ended(kind: str, key: int) -> bool:
    """Whether a component is settled by the key of its latest piece."""
    return kind != "str" or key % 8 < _TEXT_BYTES


@dataclass(frozen=True)
class _Cell:
    """Rows that agree with the ``settled`` keys of (component, level) and whose next key lies in ``bounds``; ``later`` has the
    bounds of the components after it (of a text, its first piece)."""

    settled: tuple = ()
    component: int = 0
    level: int = 0
    bounds: tuple[int, int] = _ALL
    later: tuple[tuple[int, int], ...] = ()

    def advanced(self, kinds: list[str]) -> "_Cell":
        """With every key settled on which all of its rows agree."""
        cell = self
        while cell.component < len(kinds) and cell.bounds[0] == cell.bounds[1]:
            key = cell.bounds[0]
            settled = (*cell.settled, ((cell.component, cell.level), key))
            if _ended(kinds[cell.component], key):
                cell = _Cell(settled, cell.component + 1, 0, *((cell.later[0], cell.later[1:]) if cell.later else ((), ())))
            else:
                cell = _Cell(settled, cell.component, cell.level + 1, _ALL, cell.later)
        return cell

    def rows(self, value: Callable[[int, int], Column], kinds: list[str]) -> Column:
        """The condition on the components' values: doubles are compared as they are, so only rows of the cell need keys."""
        here = F.lit(True)
        if self.bounds != _ALL:
            here = value(self.component, self.level).between(*(F.lit(_value(kinds[self.component], k)) for k in self.bounds))
        for (c, level), k in self.settled:
            here = here & (value(c, level) == F.lit(_value(kinds[c], k)))
        return here

    def bucket(self, value: Callable[[int, int], Column], kinds: list[str], bits: int) -> Column:
        """The row's next ``bits`` bits inside the bounds (one bucket more where they straddle)."""
        lo, hi = self.bounds
        x = value(self.component, self.level)
        return F.shiftright(double_key(x) if kinds[self.component] == "float" else x, max(0, (hi - lo).bit_length() - bits))


def _value(kind: str, key: int):
    return double_of_key(key) if kind == "float" else key


def _driver_key(kind: str, value) -> int:
    return key_of_double(value) if kind == "float" else value


def select_ranks(df: DataFrame, components: list[Column], kinds: list[str], ranks: Callable[[int], list[int]],
                 digit_bits: int = DIGIT_BITS) -> tuple[int, list[tuple[int, ...]]]:
    """(rows of ``df``, key tuples at the 0-based ranks ``ranks(rows)``) in the order of ``components``, which
    are never null, of the kinds int, float (without NaN) and str. Each pass is one aggregate for all ranks together. It also brings
    each bucket's bounds in the later components, so that no pass is spent where the rows agree."""
    n, wanted = None, []
    done: dict[int, tuple] = {}
    targets: list[tuple[_Cell, int, int]] = [(_Cell(later=(_ALL,) * (len(kinds) - 1)), 0, 0)]  # (range, rank left inside it, rank in all)
    while targets:
        cells = list(dict.fromkeys(cell for cell, *_ in targets))
        names = {(c, 0): f"k0_{c}" for c in range(len(kinds))}
        for cell in cells:
            for c, level in [*(at for at, _ in cell.settled), (cell.component, cell.level)]:
                names.setdefault((c, level), f"k{level}_{c}")
        keyed = df.select(*[(components[c] if kinds[c] == "float" else _key(components[c], kinds[c], level)).alias(name) for (c, level), name in names.items()])
        value = lambda c, level: F.col(names[c, level])
        place, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, cell in enumerate(cells):
            place = F.when(cell.rows(value, kinds), F.lit(i)).otherwise(place)
        for i, cell in enumerate(cells):
            bucket = F.when(F.col("cell") == i, cell.bucket(value, kinds, digit_bits)).otherwise(bucket)
        current = sorted({names[cell.component, cell.level] for cell in cells} | {f"k0_{c}" for c in range(len(kinds))})
        # rows of no cell are one group, dropped on the driver: a filter would be pushed down and find out the cells twice
        counts = (keyed.withColumn("cell", place).withColumn("bucket", bucket).groupBy("cell", "bucket")
                  .agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in current for f in (F.min, F.max)]))
        found: dict[int, list] = {i: [] for i in range(len(cells))}
        for r in counts.toArrow().to_pylist():
            if r["cell"] is not None:
                found[r["cell"]].append(r)
        if n is None:  # the first pass counts all rows
            n = sum(r["n"] for r in found[0])
            wanted = list(ranks(n))
            if any(not 0 <= r < n for r in wanted):
                raise ValueError(f"a rank of {wanted} is outside {n} rows")
            targets = [(cells[0], r, r) for r in dict.fromkeys(wanted)]
        following = []
        for cell, rest, rank in targets:
            for r in sorted(found[cells.index(cell)], key=lambda r: r["bucket"]):
                if rest < r["n"]:
                    break
                rest -= r["n"]
            def bounds(c: int, name: str) -> tuple[int, int]:
                return _driver_key(kinds[c], r[f"{name}_min"]), _driver_key(kinds[c], r[f"{name}_max"])

            later = tuple(bounds(c, f"k0_{c}") for c in range(cell.component + 1, len(kinds)))
            here = bounds(cell.component, names[cell.component, cell.level])
            cell = _Cell(cell.settled, cell.component, cell.level, here, later).advanced(kinds)
            if cell.component == len(kinds):
                done[rank] = tuple(k for _, k in cell.settled)
            else:
                following.append((cell, rest, rank))
        targets = following
    return n, [done[r] for r in wanted]


# ------------------------------------------------------------------ medians

def measured_bytes(df: DataFrame) -> int:
    """Bytes of a small table, from its own values."""
    width = F.lit(16 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(col(f.name)), F.lit(0))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def exact_median(df: DataFrame, value: str, by: list[str] | None = None, out: str = "median",
                 digit_bits: int = DIGIT_BITS, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """A5: the exact median (mean of the two middle values when their number is even) of a number column, per group with
    ``by``. Null and NaN values do not count; a group without others has no row, a table without others a null. A
    null key is a group like any other."""
    x = col(value).cast("double")
    base = df.select(*[col(b) for b in (by or [])], x.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if by:
        return _group_medians(base, list(by), out, digit_bits, broadcast_bytes)
    n, keys = select_ranks(base, [F.col("_v")], ["float"], lambda n: [(n - 1) // 2, n // 2] if n else [], digit_bits)
    middle = [double_of_key(k[0]) for k in keys]
    return df.sparkSession.createDataFrame([((middle[0] + middle[1]) / 2 if n else None,)], f"`{out}` double")


def _group_medians(base: DataFrame, by: list[str], out: str, digit_bits: int, broadcast_bytes: int) -> DataFrame:
    """Medians of every group's ``_v``. The state has one row a group: how many rows (``n``), the rank that is left of the lower middle
    value inside the range ``lo``..``hi`` of values, and the least value above that range (``above``)."""
    keys = [F.col(f"_g{i}") for i in range(len(by))]
    names = [f"_g{i}" for i in range(len(by))]
    base = base.select(*[col(b).alias(g) for b, g in zip(by, names)], "_v")
    steps = [max(0, 64 - digit_bits * i) for i in range(1, math.ceil(64 / digit_bits) + 1)]
    # of each group, the smallest shift that leaves few enough buckets between its bounds (null: too far apart)
    span = lambda s: F.try_subtract(F.shiftright("khi", s), F.shiftright("klo", s))
    shift = F.lit(steps[0])
    for s in steps[1:]:
        shift = F.when(span(s) < F.lit(2 << digit_bits), F.lit(s)).otherwise(shift)

    def narrowed(counts: DataFrame) -> DataFrame:
        """The state after a pass: from counts of (group, bucket) and the state before it."""
        order = Window.partitionBy(*keys).orderBy("bucket")
        sums = counts.withColumn("up_to", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        sums = sums.withColumn("next", F.lead("lo").over(order)).where("up_to > rest AND up_to - c <= rest")
        state = sums.select(*names, "n", (F.col("rest") - F.col("up_to") + F.col("c")).alias("rest"), "c", "lo", "hi", "klo", "khi",
                            F.coalesce("next", "above").alias("above"))
        return state.withColumn("shift", shift)

    def counted(rows: DataFrame, bucket: Column, *kept: str) -> DataFrame:
        return (rows.withColumn("_k", double_key(F.col("_v"))).groupBy(*names, bucket.alias("bucket"), *kept).agg(*ends))

    ends = [F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.min("_k").alias("klo"), F.max("_k").alias("khi")]
    first = counted(base, F.shiftright("_k", steps[0]))
    total = F.sum("c").over(Window.partitionBy(*keys))
    state = narrowed(first.withColumn("n", total).withColumn("rest", F.floor((F.col("n") - 1) / 2)).withColumn("above", F.lit(None).cast("double")))
    state = state.checkpoint(eager=True)
    while True:
        open_state = state.where("klo < khi").select(*[k.alias(f"s{g}") for k, g in zip(keys, names)], "n", "rest", "above", "shift",
                                                     F.col("lo").alias("from"), F.col("hi").alias("to"))
        size = measured_bytes(open_state)
        if not size:
            break
        same = [F.col(g).eqNullSafe(F.col(f"s{g}")) for g in names]
        rows = base.join(F.broadcast(open_state) if size <= broadcast_bytes else open_state, [*same, F.col("_v").between(F.col("from"), F.col("to"))])
        state = narrowed(counted(rows, F.expr("shiftright(_k, shift)"), "n", "rest", "above", "shift").drop("shift")).unionByName(state.where("klo >= khi"))
        state = state.checkpoint(eager=True)
    # the upper middle value: the same one while the range holds further rows, else the least above it
    upper = F.when((F.col("n") % 2 == 1) | (F.col("rest") + 1 < F.col("c")), F.col("lo")).otherwise(F.col("above"))
    return state.select(*[F.col(g).alias(b) for g, b in zip(names, by)], ((F.col("lo") + upper) / 2).alias(out))


# --------------------------------------------------------------- cut points

def cut_keys(df: DataFrame, order: list[str], ranks: Callable[[int], list[int]], digit_bits: int = DIGIT_BITS) -> tuple[int, list[dict]]:
    """(rows, the ``order`` values of the rows at ``ranks(rows)``) of the ascending order, nulls last. ``order`` ends
    in a unique key. Nothing is sorted or numbered."""
    from shoplane.operators.ordered import _components
    components, kinds = _components(df, order)
    n, keys = select_ranks(df, components, kinds, ranks, digit_bits)
    if not keys:
        return n, []
    wanted, names = sorted(set(keys)), {}
    for key in wanted:
        for at in _levels(kinds, key):
            names.setdefault(at, f"k{at[1]}_{at[0]}")
    fields = [f"o{i}" for i in range(len(order))]
    # numbers are compared as they are; rows of no cut are left out before they are grouped (their structs would all be sorted)
    keyed = df.select(*[(components[c] if kinds[c] == "float" else _key(components[c], kinds[c], level)).alias(name) for (c, level), name in names.items()],
                      *[_as_value(col(c), df.schema[c].dataType).alias(f) for c, f in zip(order, fields)])
    which = F.lit(None).cast("int")
    for i, key in enumerate(wanted):
        here = F.lit(True)
        for at, k in zip(_levels(kinds, key), key):
            here = here & (F.col(names[at]) == F.lit(_value(kinds[at[0]], k)))
        which = F.when(here, F.lit(i)).otherwise(which)
    # equal keys are equal values: any row of a cut has them
    rows = keyed.select(which.alias("at"), *fields).where("at IS NOT NULL").groupBy("at").agg(F.min(F.struct(*fields)).alias("v")).collect()
    found = {wanted[r["at"]]: {c: r["v"][f] for c, f in zip(order, fields)} for r in rows}
    return n, [found[k] for k in keys]


def _levels(kinds: list[str], key: tuple[int, ...]) -> list[tuple[int, int]]:
    """(component, level) of each key of a tuple: a text has as many pieces as its keys say."""
    out, c, level = [], 0, 0
    for k in key:
        out.append((c, level))
        c, level = (c + 1, 0) if _ended(kinds[c], k) else (c, level + 1)
    return out


def _as_value(x: Column, dt: T.DataType) -> Column:
    """What a key keeps of an order column: timestamps as text or microseconds, which no time zone shifts on the way."""
    return x.cast("string") if isinstance(dt, T.TimestampNTZType) else F.unix_micros(x) if isinstance(dt, T.TimestampType) else x


def _as_literal(v, dt: T.DataType) -> Column:
    return F.timestamp_micros(F.lit(v)) if isinstance(dt, T.TimestampType) else F.lit(v).cast(dt)


def before(df: DataFrame, order: list[str], key: dict) -> Column:
    """Rows that come before a ``cut_keys`` key in the order (nulls last): never null, and over the bare columns, so
    that scans can use it."""
    out, same = None, None
    for c in order:
        x, v, dt = col(c), key[c], df.schema[c].dataType
        there = x.isNotNull()
        less = there if v is None else there & (x < _as_literal(v, dt))
        equal = ~there if v is None else there & (x == _as_literal(v, dt))
        out = less if out is None else out | (same & less)
        same = equal if same is None else same & equal
    return out


def segment(df: DataFrame, order: list[str], keys: list[dict]) -> Column:
    """How many of the ascending ``keys`` are at or before the row. Row and key are compared as structs, in which a flag
    beside each value puts nulls last: one short method a key, where ``before`` of all keys would be one too long to be compiled."""
    if not keys:
        return F.lit(0)

    def flagged(values: list[Column]) -> Column:
        return F.struct(*[f for i, v in enumerate(values) for f in (v.isNull().alias(f"n{i}"), v.alias(f"v{i}"))])

    row, at = flagged([col(c) for c in order]), F.lit(0)
    for key in keys:
        cut = flagged([F.lit(None).cast(df.schema[c].dataType) if key[c] is None else _as_literal(key[c], df.schema[c].dataType) for c in order])
        at = at + (row >= cut).cast("int")
    return at
