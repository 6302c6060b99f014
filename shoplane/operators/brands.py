"""Brand/model resolution.

``match_brand`` resolves free text such as "Trek FX 7.4" against a brand
dictionary: the text's word n-grams (up to the longest dictionary name) are
equi-joined to the dictionary's normal forms, the longest match wins (then the
leftmost), the brand is the dictionary name and the model is the text with the
matched words removed; no match gives brand ``'Unknown'`` and the whole text as
model; null/blank text gives empty strings. One-word names that are ordinary
words (``common_words``) match in leading position only.

Scale: work is done once per *distinct* text (partial dedupe before the
shuffle, so a text repeated on a third of the rows costs one row). N-gram rows
carry the text's SHA-256, not the text, so long texts cost linear space. The
dictionary is broadcast only when its measured bytes are under
``broadcast_max_bytes``. Null and blank rows never enter the join back on the
text; AQE splits a hot text's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplane.functions import coerce as C
from shoplane.functions import text as X
from shoplane.functions import wordlists as W
from shoplane.operators.schema import col
from pyspark.sql import types as T

BRAND_MODEL = T.StructType([T.StructField("brand", T.StringType()),
                            T.StructField("model", T.StringType())])


def _dictionary(dictionary: DataFrame) -> DataFrame:
    """norm -> display brand (smallest name when several share a norm) and
    the sections it appears in."""
    return (dictionary.filter(F.col("norm").isNotNull() & (F.col("norm") != ""))
            .groupBy("norm").agg(F.min("brand").alias("brand"),
                                 F.sort_array(F.collect_set("section")).alias("sections"),
                                 F.size(F.split("norm", " ")).alias("words")))


def resolve_brands(texts: DataFrame, text_col: str, dictionary: DataFrame, forms=None,
                   common_words=W.COMMON_WORD_BRANDS, finish=None,
                   broadcast_max_bytes: int = 32 << 20) -> DataFrame:
    """Distinct texts -> (text, brand, model, sections).

    ``forms(text)`` lists the blank-separated forms to look up, best first
    (default: the text with separators normalised); a match in an earlier form
    wins. ``finish`` cleans the model words left over.
    """
    forms = forms or (lambda c: [X.normalize_separators(c)])
    finish = finish or (lambda c: c)
    # the dictionary summary is small and used twice: materialise once
    d = _dictionary(dictionary).checkpoint(eager=True)
    st = d.agg(F.max("words").alias("w"),
               F.sum(F.octet_length("norm") + F.octet_length("brand")
                     + F.octet_length(F.array_join("sections", " ")) + 64).alias("b")).first()
    max_words = st["w"] or 1
    if (st["b"] or 0) <= broadcast_max_bytes:  # broadcast only under a measured bound
        d = F.broadcast(d)
    src = (texts.select(col(text_col).alias("_t")).filter(X.strip_ws(F.col("_t")) != "")
           .distinct().withColumn("_h", F.sha2("_t", 256)))
    toks = src.select("_h", "_t", F.array(*[F.split(f, " ") for f in forms(F.col("_t"))]).alias("_forms"))
    pos = (toks.select("_h", F.posexplode("_forms").alias("_v", "_tok"))
           .select("_h", "_v", F.explode(_grams(F.transform("_tok", lambda w: F.lower(w)), int(max_words))).alias("_x"))
           .select("_h", "_v", "_x.*"))
    hits = pos.join(d, pos["_g"] == d["norm"])
    if common_words:
        hits = hits.filter((F.col("_s") == 0) | ~F.col("norm").isin(*common_words))
    best = hits.groupBy("_h").agg(F.max_by(F.struct("brand", "sections", "_v", "_s", "_k"),
                                           F.struct(-F.col("_v"), F.col("_k"), -F.col("_s"))).alias("_m"))
    res = toks.join(best, "_h", "left")
    tok = F.element_at("_forms", F.col("_m._v") + 1)
    model = finish(F.array_join(F.concat(F.slice(tok, 1, F.col("_m._s")),
                                         F.slice(tok, F.col("_m._s") + F.col("_m._k") + 1, F.size(tok))), " "))
    whole = F.array_join(F.element_at("_forms", -1), " ")
    return res.select(
        "_t",
        F.when(F.col("_m").isNotNull(), F.col("_m.brand")).when(whole == "", "").otherwise("Unknown").alias("brand"),
        F.when(F.col("_m").isNull(), whole).otherwise(model).alias("model"),
        F.col("_m.sections").alias("sections"))


def _grams(words, longest: int):
    """array<struct<_s, _k, _g>>: every run of 1..``longest`` words."""
    def at(s):
        ks = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - s))
        return F.transform(ks, lambda k: F.struct(s.alias("_s"), k.alias("_k"),
                                                  F.array_join(F.slice(words, s + 1, k), " ").alias("_g")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), at))


def match_brand(df: DataFrame, text_col: str, dictionary: DataFrame, out: str = "brand_model",
                **kw) -> DataFrame:
    """Add ``out`` = struct<brand, model> (and keep the rest of the row)."""
    r = resolve_brands(df, text_col, dictionary, **kw)
    blank = F.coalesce(X.strip_ws(col(text_col)) == "", F.lit(True))
    keep = [col(c) for c in df.columns]
    found = df.filter(~blank).join(r, col(text_col) == r["_t"], "left").select(
        *keep, F.struct(F.col("brand"), F.col("model")).cast(BRAND_MODEL).alias(out))
    empty = df.filter(blank).select(*keep, C.empty_struct(BRAND_MODEL).cast(BRAND_MODEL).alias(out))
    return found.unionByName(empty)


def clean_brand_text(c, prefixes=W.BRAND_PREFIXES, descriptors=W.BRAND_DESCRIPTORS,
                     prefix_word_boundary: bool = False):
    """X2 -> X3 -> X4 on a brand/model column."""
    return X.remove_descriptors(X.strip_prefix(c, prefixes, prefix_word_boundary), descriptors)


def clean_brand_model(df: DataFrame, text_col: str, dictionary: DataFrame,
                      brand_col: str = "Cleaned Brand", model_col: str = "Cleaned Model",
                      prefixes=W.BRAND_PREFIXES, descriptors=W.BRAND_DESCRIPTORS,
                      faithful: bool = False, **kw) -> DataFrame:
    """Stock prefix off, dictionary match, descriptors off; the result is
    split into ``brand_col`` and ``model_col`` (P11).

    By default a prefix needs a word boundary ("Espin" stays whole) and the
    text is looked up before its descriptors go ("Swift Folder 8" keeps its
    brand), then without them. ``faithful=True`` strips prefixes without a
    boundary and looks the text up after descriptor removal only.
    """
    if faithful:
        def forms(c):
            return [clean_brand_text(c, prefixes, descriptors)]
        kw = {"common_words": [], **kw}
    else:
        spaced = [*descriptors, *(d.replace("-", " ") for d in descriptors if "-" in d)]

        def forms(c):
            bare = X.strip_prefix(c, prefixes, True)
            return [X.normalize_separators(bare), X.remove_descriptors(bare, descriptors)]
        kw = {"common_words": [*W.COMMON_WORD_BRANDS, *descriptors],
              "finish": lambda c: X.remove_descriptors(c, spaced), **kw}
    m = match_brand(df, text_col, dictionary, out="_bm", forms=forms, **kw)
    return (m.withColumn(brand_col, F.col("_bm.brand")).withColumn(model_col, F.col("_bm.model"))
            .drop("_bm"))
