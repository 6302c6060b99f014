"""Text expressions (X1-X11). Every function maps Column -> Column and stays
inside Catalyst (regexp_replace, split, higher-order array functions), so the
work is codegen'd and runs wherever the rows already are -- no shuffle.

Regex flags: Java's ``(?U)`` gives Unicode ``\\w \\s \\b \\d`` like Python's
``re`` on str; ``(?m)`` with ``(?d)`` makes ``^`` start a line only after
``\\n`` (Python's MULTILINE), not after a bare ``\\r``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplane.functions import wordlists as W

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


_REGEX_META = set(r"\.^$|?*+()[]{}/-")


def regex_escape(s: str) -> str:
    """Escape a literal for Java regex (and RE2)."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in s)


def strip_ws(c: ColumnOrName) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip``).

    Spark's ``trim`` removes blanks only, so a regex is used.
    """
    return F.regexp_replace(_col(c), r"(?U)\A\s+|\s+\z", "")


def collapse_ws(c: ColumnOrName) -> Column:
    """Collapse whitespace runs to one blank and strip the ends (X4 tail)."""
    return strip_ws(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def strip_note_header(c: ColumnOrName, pattern: str = W.NOTE_HEADER_PATTERN) -> Column:
    """Remove author/date header lines from a note, then strip."""
    return strip_ws(F.regexp_replace(_col(c), "(?mdU)" + pattern, ""))


def strip_prefix(c: ColumnOrName, prefixes: list[str] = W.BRAND_PREFIXES,
                 word_boundary: bool = False) -> Column:
    """Strip the first prefix (list order) the text starts with,
    case-insensitively; the rest is whitespace-stripped.

    ``word_boundary=False`` reproduces the plain startswith test (so "Espin"
    loses "Es"); ``True`` requires a non-word character or the end after the
    prefix.
    """
    col = _col(c)
    # one ordered alternation: the first listed prefix that fits is taken off
    end = r"(?=\W|$)" if word_boundary else ""
    pattern = ("(?iuU)^(?:" if word_boundary else "(?iu)^(?:") + "|".join(regex_escape(p) for p in prefixes) + ")" + end
    return F.when(col.rlike(pattern), strip_ws(F.regexp_replace(col, pattern, ""))).otherwise(col)


def descriptor_pattern(descriptors: list[str] = W.BRAND_DESCRIPTORS) -> str:
    return r"\b(" + "|".join(regex_escape(d) for d in descriptors) + r")\b"


def remove_descriptors(c: ColumnOrName, descriptors: list[str] = W.BRAND_DESCRIPTORS) -> Column:
    """X3 + X4: drop descriptor words (whole word, any case), turn ``-``/``_``
    into blanks, collapse whitespace and strip."""
    no_desc = F.regexp_replace(_col(c), "(?iU)" + descriptor_pattern(descriptors), "")
    return normalize_separators(no_desc)


def normalize_separators(c: ColumnOrName) -> Column:
    """``-`` and ``_`` to blanks, collapse whitespace, strip."""
    return collapse_ws(F.regexp_replace(_col(c), r"[\-_]", " "))


def letters_only(c: ColumnOrName) -> Column:
    """X6 + X7: lower-case, keep ASCII letters and whitespace."""
    return F.regexp_replace(F.lower(_col(c)), r"(?U)[^a-zA-Z\s]", "")


def split_contractions(c: ColumnOrName, pairs=W.TOKEN_CONTRACTIONS) -> Column:
    """Part of X8: split the contractions the word tokenizer splits, in one
    regex pass (a blank is inserted after the first part, only inside a whole
    word that is one of the contractions)."""
    words = "|".join(a + b for a, b in pairs)
    firsts = "|".join(sorted({a for a, _ in pairs}))
    begin = "".join(sorted({re.escape(a[:1]) for a, _ in pairs}))  # most characters are ruled out by this set alone
    return F.regexp_replace(_col(c), rf"(?=[{begin}])\b(?=(?:{words})\b)({firsts})", "$1 ")


def tokenize(c: ColumnOrName) -> Column:
    """Whitespace tokens (empty strings removed), contractions split."""
    parts = F.split(split_contractions(c), r"(?U)\s+")
    return F.filter(parts, lambda t: t != "")


def remove_stop_words(tokens: ColumnOrName, stop_words: list[str] = W.ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words. ``isin`` over literals becomes a hash-set lookup
    (InSet) per token."""
    stop = sorted(set(stop_words))
    return F.filter(_col(tokens), lambda t: ~t.isin(*stop))


def lemmatize_nouns(tokens: ColumnOrName, rules=W.NOUN_SUFFIX_RULES,
                    keep_endings=W.NOUN_KEEP_ENDINGS, min_stem: int = 2,
                    lemmas: dict[str, str] = W.NOUN_LEMMAS) -> Column:
    """Noun lemmas from the table ``lemmas``, for other words by suffix
    rules (longest matching suffix first).

    A rule applies only if at least ``min_stem`` characters remain; the bare
    "s" rule skips words ending in ``keep_endings``.
    """
    known = F.create_map(*[F.lit(x) for kv in sorted(lemmas.items()) for x in kv]) if lemmas else None

    def one(w: Column) -> Column:
        out = w
        for suffix, repl in reversed(rules):
            cond = w.endswith(suffix) & (F.length(w) - len(suffix) >= min_stem)
            if suffix == "s":
                for k in keep_endings:
                    cond = cond & ~w.endswith(k)
            stem = w.substr(F.lit(1), F.length(w) - len(suffix))
            out = F.when(cond, F.concat(stem, F.lit(repl))).otherwise(out)
        return out if known is None else F.coalesce(F.try_element_at(known, w), out)
    return F.transform(_col(tokens), one)


def join_tokens(tokens: ColumnOrName) -> Column:
    """X11: tokens back to one blank-separated string."""
    return F.array_join(_col(tokens), " ")


def preprocess_text(c: ColumnOrName, stop_words: list[str] = W.ENGLISH_STOP_WORDS) -> Column:
    """X6-X11 chained: the text preprocessing of the description column.

    Null text is treated as empty text.
    """
    toks = tokenize(letters_only(F.coalesce(_col(c), F.lit(""))))
    return join_tokens(lemmatize_nouns(remove_stop_words(toks, stop_words)))


def has_note_date(c: ColumnOrName, pattern: str = W.NOTE_DATE_PATTERN) -> Column:
    """Predicate of F1: not null, not empty, contains a d/m/Y date."""
    col = _col(c)
    return col.isNotNull() & (col != "") & col.rlike(pattern)
