"""Noun lemmas from a lexicon table.

A word's lemma is its exact form's entry among the exceptions, else the stem of the longest suffix rule whose
stem the lexicon knows, else the word itself. The lookup runs once per distinct word, as joins; what
the rows get is the table of the words that change.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.functions import text as X
from shoplane.functions import wordlists as W
from shoplane.operators.schema import col
from shoplane.operators.selection import measured_bytes

#: Buckets of the changed words that rows look up by hash.
_BUCKETS = 1 << 12


def _near(table: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``table`` to be broadcast if its measured size allows it."""
    return F.broadcast(table) if measured_bytes(table) <= broadcast_bytes else table


def exceptions_frame(spark, lemmas: dict[str, str] = W.NOUN_LEMMAS) -> DataFrame:
    return spark.createDataFrame(sorted(lemmas.items()), "form string, lemma string")


def lemma_table(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame, rules=W.MORPHY_NOUN_RULES, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(word, lemma) of the distinct non-null ``words`` (column word) whose lemma is another word. ``lexicon`` has a column
    lemma, ``exceptions`` form and lemma; repeated entries are one, of contradictory exceptions the least counts."""
    words = words.select("word").where("word IS NOT NULL").distinct().checkpoint(eager=True)
    known = lexicon.select(F.col("lemma").alias("stem")).where("stem IS NOT NULL").distinct().checkpoint(eager=True)  # measured, then joined
    exact = exceptions.where("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("exact"))
    word = F.col("word")
    stems = [F.when(word.endswith(suffix) & (F.length(word) > len(suffix)),
                    F.struct(F.lit(-len(suffix)).alias("place"), F.concat(word.substr(F.lit(1), F.length(word) - len(suffix)), F.lit(new)).alias("stem")))
             for suffix, new in rules]
    tried = words.select("word", F.inline(F.filter(F.array(*stems), lambda s: s.isNotNull())))
    ruled = (tried.join(_near(known, broadcast_bytes), "stem").groupBy(word.alias("w")).agg(F.min_by("stem", "place").alias("ruled")))
    table = (words.join(_near(exact, broadcast_bytes), word == F.col("form"), "left").join(ruled, word == F.col("w"), "left")
             .select("word", F.coalesce("exact", "ruled").alias("lemma")))
    return table.where("lemma <> word")


def lemmatize_rows(df: DataFrame, tokens_col: str, table: DataFrame, key: str, plan_bytes: int = 1 << 20) -> DataFrame:
    """``df`` with the words of the array ``tokens_col`` replaced by their lemmas in ``table`` (``lemma_table``).

    Up to ``plan_bytes`` of changed words they are a constant of the plan, in hash buckets of a few words each;
    beyond, the words are joined and put together again by the unique non-null column ``key``."""
    tokens = col(tokens_col)
    table = table.checkpoint(eager=True)
    if measured_bytes(table) <= plan_bytes:
        bucket = lambda w: F.pmod(F.hash(w), F.lit(_BUCKETS))
        maps: list[dict] = [{} for _ in range(_BUCKETS)]
        for r in table.select(bucket(F.col("word")).alias("b"), "word", "lemma").collect():
            maps[r["b"]][r["word"]] = r["lemma"]
        held = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")  # a constant of the plan
        return df.withColumn(tokens_col, F.transform(tokens, lambda w: F.coalesce(F.try_element_at(F.element_at(held, bucket(w) + 1), w), w)))
    words = df.select(col(key).alias("_k"), F.posexplode(tokens).alias("_i", "word")).join(table, "word", "left")
    again = words.groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.coalesce("lemma", "word").alias("w")))), lambda x: x["w"]).alias("_t"))
    joined = df.join(again, col(key) == F.col("_k"), "left")
    replaced = F.when(tokens.isNotNull(), F.coalesce("_t", tokens))  # an empty array has no words to put together
    return joined.withColumn(tokens_col, replaced).drop("_k", "_t")


def cleaned_tokens(text: Column, stop_words: list[str] = W.ENGLISH_STOP_WORDS) -> Column:
    """The tokens of a text that get lemmas: lower-case, letters only, no stop words."""
    return X.remove_stop_words(X.tokenize(X.letters_only(F.coalesce(text, F.lit("")))), stop_words)


def held_words(rows: DataFrame, tokens_col: str, key: str) -> DataFrame:
    """(word, n): how many different ``key`` values hold each word. Rows whose key comes once are counted word by word, so that a task
    sends one row a word; only those of repeated keys are made distinct by key."""
    often = rows.groupBy(col(key).alias("_r")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_r", F.lit(True).alias("_often")).checkpoint(eager=True)
    marked = rows.select(col(key).alias("_k"), F.array_distinct(col(tokens_col)).alias("_t")).join(_near(often, 32 << 20), F.col("_k").eqNullSafe(F.col("_r")), "left")
    once = marked.where("_often IS NULL").select(F.explode("_t").alias("word"))
    more = marked.where("_often").select("_k", F.explode("_t").alias("word")).distinct().select("word")
    return once.unionByName(more).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def preprocess_with_lexicon(df: DataFrame, text_col: str, out: str, key: str, lexicon: DataFrame, exceptions: DataFrame | None = None,
                            stop_words: list[str] = W.ENGLISH_STOP_WORDS, **kw) -> DataFrame:
    """E8 with dictionary-checked lemmas: lower-case, letters only, tokens, no stop words, noun lemmas, joined again. ``text_col`` may
    hold the ``cleaned_tokens`` themselves, where they are stored already."""
    stored = isinstance(df.schema[text_col].dataType, T.ArrayType)
    rows = df.withColumn(out, col(text_col) if stored else cleaned_tokens(col(text_col), stop_words))
    exceptions = exceptions_frame(df.sparkSession) if exceptions is None else exceptions
    table = lemma_table(rows.select(F.explode(out).alias("word")), lexicon, exceptions)
    return lemmatize_rows(rows, out, table, key, **kw).withColumn(out, X.join_tokens(col(out)))
