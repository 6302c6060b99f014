"""Type coercion expressions.

ANSI mode is on, so a plain cast of bad text raises; the lenient variants use
``try_*`` and an explicit numeric-shape guard (Spark would otherwise accept
Java float suffixes such as ``'12d'``).
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.functions.text import ColumnOrName, _col

# Plain decimal / scientific number, optional sign and surrounding blanks.
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

DEFAULT_TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy h:mm a",
    "M/d/yyyy",
]


def to_ts(c: ColumnOrName, strict: bool = True, formats: list[str] | None = None,
          dtype: T.DataType | None = None, day_first: bool = False) -> Column:
    """Text to TIMESTAMP_NTZ (wall-clock time, like a naive datetime).

    ``strict=True`` raises on unparsable text (ANSI cast); ``strict=False``
    returns null for it, trying ISO forms (any fraction, zone ignored) and then
    ``formats`` in order, with day and month exchanged first if ``day_first``; a text that fits no format
    in the given order is tried in the other one (16/12 has no 16th month). Columns that are already
    dates or timestamps are cast directly.
    """
    col = _col(c)
    if dtype is not None and not isinstance(dtype, T.StringType):
        return col.cast("timestamp_ntz")
    if strict:
        return col.cast("timestamp_ntz")
    fmts = formats or DEFAULT_TIMESTAMP_FORMATS
    exchanged = [f.replace("M/d/", "d/M/") for f in fmts if "M/d/" in f]
    if day_first:
        fmts = [f.replace("M/d/", "d/M/") for f in fmts] + [f for f in fmts if "M/d/" in f]
    elif not formats:
        fmts = [*fmts, *(f for f in exchanged if f not in fmts)]
    tries = _by_formats(col, fmts)
    iso = [] if formats else [F.when(col.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), col.try_cast("timestamp_ntz"))]
    return F.coalesce(*iso, *tries)


def _separators(fmt: str) -> str:
    """The separators that a text of the format has ("" if that isn't plain: optional or quoted parts other than the default ones)."""
    plain = re.sub(r"'T'|\[\.S+\]", "", fmt)
    return "" if re.search(r"['\[\]]", plain) else "".join(sorted(set(re.findall(r"[/:-]", plain))))


def _by_formats(col: Column, fmts: list[str]) -> list[Column]:
    """``col`` by each format in order. Formats are tried only where the text has their separators, since a failed try costs many
    times a parsed text; neighbours of the same separators share the test, which keeps the generated method short enough to be compiled."""
    out = []
    for separators, group in groupby(fmts, _separators):
        parsed = F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in group]).cast("timestamp_ntz")
        out.append(F.when(reduce(and_, [col.contains(c) for c in separators]), parsed) if separators else parsed)
    return out


def to_number(c: ColumnOrName) -> Column:
    """Lenient text -> double: plain numbers only, anything else null."""
    col = _col(c).cast("string")
    return F.when(col.rlike(NUMBER_SHAPE), col.try_cast("double"))


def to_quantity(c: ColumnOrName) -> Column:
    """Parse, unparsable/NaN/infinite -> 0, truncate toward zero to long.
    Whole-number text is read exactly; a number outside the long range raises."""
    text = F.trim(_col(c).cast("string"))
    x = to_number(c)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return (F.when(text.rlike(r"^[+-]?\d+$"), text.cast("long"))
            .when(finite, x.cast("long")).otherwise(F.lit(0).cast("long")))


def to_dollars(c: ColumnOrName) -> Column:
    """Parse, unparsable -> 0.0, double."""
    return F.coalesce(to_number(c), F.lit(0.0))


def money_to_double(c: ColumnOrName) -> Column:
    """Drop ``$`` and ``,`` then parse; unparsable (``'(5)'``, ``'12d'``,
    ``'abc'``) -> null."""
    return to_number(F.regexp_replace(_col(c).cast("string"), r"[$,]", ""))


def to_text(c: ColumnOrName) -> Column:
    """Stringify, NULL stays NULL (no literal 'nan')."""
    return _col(c).cast("string")


def to_float32(c: ColumnOrName) -> Column:
    """P14."""
    return _col(c).cast("float")


def parse_json_struct(c: ColumnOrName, schema: T.StructType) -> Column:
    """JSON text -> struct when it is an object holding every schema key,
    else null. Key presence is checked with ``json_object_keys`` so an explicit
    JSON null still counts as present."""
    col = _col(c)
    keys = F.json_object_keys(col)
    has_all = F.lit(True)
    for f in schema.fields:
        has_all = has_all & F.coalesce(F.array_contains(keys, f.name), F.lit(False))
    return F.when(has_all, F.from_json(col, schema))


def empty_struct(schema: T.StructType) -> Column:
    """A struct with an empty string in every (string) field."""
    return F.struct(*[F.lit("").cast(f.dataType).alias(f.name) for f in schema.fields])


def blank_to_empty_struct(c: ColumnOrName, value: Column, schema: T.StructType) -> Column:
    """null/blank input -> struct of empty strings, else ``value``."""
    return F.when(F.coalesce(_col(c), F.lit("")) == "", empty_struct(schema)).otherwise(value)
