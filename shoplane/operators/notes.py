"""Work-order note splitting.

A note may carry an author/date header ``First Last (d/m/Y H:M:S)`` on its
first or last line. ``split_note`` returns struct<cleaned_text, author, date>:
leading header first, else trailing header, else the whole (stripped) text
with empty author/date. ``note_fallback`` is the degraded form used when an
extractor fails: the header-stripped text (X1) with empty author/date.
All regex expressions, evaluated in place (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.functions import text as X
from shoplane.functions.text import ColumnOrName, _col

NOTE_STRUCT = T.StructType([T.StructField("cleaned_text", T.StringType()),
                            T.StructField("author", T.StringType()),
                            T.StructField("date", T.StringType())])

_HEADER = r"(\w+\s+\w+)\s+\((\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2})\)"
LEADING = r"(?sU)\A\s*" + _HEADER + r"[ \t]*(?:\r?\n|\z)(.*)\z"
TRAILING = r"(?sU)\A(.*?)(?:\r?\n|\A)[ \t]*" + _HEADER + r"\s*\z"


def split_note(c: ColumnOrName) -> Column:
    """E3."""
    x = F.coalesce(_col(c), F.lit(""))
    lead = x.rlike(LEADING)
    trail = x.rlike(TRAILING)
    text = (F.when(lead, F.regexp_extract(x, LEADING, 3))
            .when(trail, F.regexp_extract(x, TRAILING, 1)).otherwise(x))
    author = (F.when(lead, F.regexp_extract(x, LEADING, 1))
              .when(trail, F.regexp_extract(x, TRAILING, 2)).otherwise(F.lit("")))
    date = (F.when(lead, F.regexp_extract(x, LEADING, 2))
            .when(trail, F.regexp_extract(x, TRAILING, 3)).otherwise(F.lit("")))
    return F.struct(X.strip_ws(text).alias("cleaned_text"),
                    F.regexp_replace(author, r"(?U)\s+", " ").alias("author"), date.alias("date"))


def note_fallback(c: ColumnOrName) -> Column:
    """E4."""
    return F.struct(X.strip_note_header(F.coalesce(_col(c), F.lit(""))).alias("cleaned_text"),
                    F.lit("").alias("author"), F.lit("").alias("date"))


def split_note_columns(df, note_col: str = "Work Order Internal Note",
                       text_col: str = "Cleaned Work Order Internal Note",
                       author_col: str = "Note Author", date_col: str = "Note Date"):
    """E3 applied and split into three columns."""
    s = split_note(F.col(f"`{note_col}`"))
    return (df.withColumn("_note", s)
            .withColumn(text_col, F.col("_note.cleaned_text"))
            .withColumn(author_col, F.col("_note.author"))
            .withColumn(date_col, F.col("_note.date")).drop("_note"))
