"""Language ID by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter n-gram is the
product of its letters' vectors, each rotated by its place in the n-gram; a
document is the sum of its n-grams' vectors; a language prototype is the sum of
its documents' unit vectors. A document gets the language whose prototype has
the largest cosine with it.

Work per batch: distinct n-grams of the batch get their vectors, a count matrix
(documents x n-grams) is multiplied with them, and the result with the prototypes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.llm.common import fold, materialize, worker_state

UNDETERMINED = "und"
_SPACE = 32
#: Characters of text handled at once.
_BATCH_CHARS = 120_000
#: n-gram vectors held at once.
_GRAMS = 4096
#: Prototype sums are rounded to this grain, so that their order of addition doesn't matter.
_GRAIN = 1e6


def _letter_table() -> np.ndarray:
    state = worker_state("language_id")
    if "letters" not in state:
        state["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return state["letters"]


class Hypervectors:
    """Seeded letter vectors and the vectors of texts."""

    def __init__(self, dim: int, ngram: int, seed: int):
        self.dim, self.ngram, self.seed = dim, ngram, seed
        self.row: dict[int, int] = {}
        self.table = np.zeros((0, dim), np.int8)

    def _rows(self, letters: np.ndarray) -> np.ndarray:
        new = [c for c in letters.tolist() if c not in self.row]
        if new:
            for c in new:
                self.row[c] = len(self.row)
            made = [np.random.default_rng([self.seed, c]).integers(0, 2, self.dim, np.int8) * 2 - 1 for c in new]
            self.table = np.vstack([self.table, np.array(made, np.int8)])
        return np.array([self.row[c] for c in letters.tolist()], np.int64)

    def _letters(self, text: str) -> np.ndarray:
        """Code points of the lower-cased text, runs of non-letters as one space, a space at either end."""
        cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        cps = np.where(_letter_table()[cps], cps, _SPACE)
        cps = np.concatenate([[_SPACE], cps, [_SPACE]])
        return cps[(cps != _SPACE) | np.append(True, cps[:-1] != _SPACE)]

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sums of n-gram vectors, whether a text has a letter)."""
        return self.vectors_and_sizes(texts)[:2]

    def vectors_and_sizes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``vectors`` and the texts' numbers of n-grams."""
        seqs = [self._letters(t) for t in texts]
        has = np.array([bool((s != _SPACE).any()) for s in seqs], bool)
        n = self.ngram
        grams = [np.stack([s[i:len(s) - n + 1 + i] for i in range(n)]) for s in seqs if len(s) >= n]
        owner = np.repeat([i for i, s in enumerate(seqs) if len(s) >= n], [g.shape[1] for g in grams]).astype(np.int64)
        out, sizes = np.zeros((len(texts), self.dim), np.float32), np.bincount(owner, minlength=len(texts))
        if not len(owner):
            return out, has, sizes
        letters, places = np.unique(np.concatenate(grams, axis=1), return_inverse=True)
        places = places.reshape(n, -1)
        code = np.zeros(len(owner), np.int64)
        for p in places:  # letters of a batch are few, so a code of n of them fits a long
            code = code * len(letters) + p
        which, distinct = pd.factorize(code)
        rows = self._rows(letters)
        counts = np.bincount(owner * len(distinct) + which, minlength=len(texts) * len(distinct))
        counts = counts.reshape(len(texts), -1).astype(np.float32)
        rolled = [np.roll(self.table[rows], i, axis=1) for i in range(n)]
        for lo in range(0, len(distinct), _GRAMS):  # whole numbers below 2**24: the order of addition doesn't matter
            part = distinct[lo:lo + _GRAMS]
            product = rolled[n - 1][part % len(letters)]
            for i in range(n - 2, -1, -1):
                part = part // len(letters)
                product *= rolled[i][part % len(letters)]
            out += counts[:, lo:lo + _GRAMS] @ product.astype(np.float32)
        return out, has, sizes


def _batches(texts: list[str], most: int = 32):
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= _BATCH_CHARS or i + 1 - lo >= most:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _encoder(dim: int, ngram: int, seed: int) -> Hypervectors:
    state = worker_state("language_id")
    return state.setdefault(f"hypervectors:{dim}:{ngram}:{seed}", Hypervectors(dim, ngram, seed))


def training_rows(docs: DataFrame, where, per_language: int, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """(t_id, t_lang): at most ``per_language`` ids of each language, lowest id hash first."""
    ids = docs.where(where & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("t_id"), F.col(lang_col).alias("t_lang"))
    ids = ids.withColumn("place", F.pmod(F.xxhash64("t_id"), F.lit(1 << 30)))
    # about 4 times the wanted rows of a language, by a hash threshold from its count, so no language fills one task
    sizes = materialize(ids.groupBy("t_lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    if sizes.count() <= 100_000:  # a row a language; else joined by shuffle
        sizes = F.broadcast(sizes)
    near = ids.join(sizes, "t_lang").where(F.col("place") * F.col("n").cast("double") < F.lit(float((1 << 30) * 4 * per_language)))
    order = Window.partitionBy("t_lang").orderBy("place", "t_id")
    chosen = near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.lit(per_language))
    return chosen.select("t_id", "t_lang").distinct()


def learn_prototypes(docs: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     per_language: int = 800, dim: int = 1024, ngram: int = 3, seed: int = 42) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit prototypes, from at most ``per_language``
    documents of each that ``where`` admits. The model (languages x ``dim``) is
    all that reaches the driver."""
    chosen = training_rows(docs, where, per_language, id_col, lang_col)
    if chosen.count() <= 100_000:  # bounded by languages x per_language
        chosen = F.broadcast(chosen)
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.join(chosen, (F.col("d_id") == F.col("t_id")) & (F.col("l") == F.col("t_lang"))).select("l", "t")

    def run(batches):
        made = _encoder(dim, ngram, seed)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _batches(texts):
                v, _ = made.vectors(texts[lo:hi])
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                for lang, row in zip(langs[lo:hi], np.rint(v * _GRAIN).astype(np.int64)):
                    total[lang] = total.get(lang, 0) + row
        for lang, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([row.tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.mapInArrow(run, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in sums})
    proto = np.zeros((len(langs), dim), np.float64)
    at = {lang: k for k, lang in enumerate(langs)}
    for r in sums:
        proto[at[r.lang], r.i] = r.x
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
    return langs, proto.astype(np.float32)


def predict_language(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                     ngram: int = 3, seed: int = 42) -> DataFrame:
    """(id, lang_pred, score): the best cosine (0 to 1) and its language; ties go
    to the first language by name. Null texts, texts without a letter and any text
    when no language was learned are ``und`` with score 0."""
    id_type, dim = docs.schema[id_col].dataType, prototypes.shape[1]

    def run(batches):
        made = _encoder(dim, ngram, seed)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            preds, scores = [], []
            for lo, hi in _batches(texts):
                v, has = made.vectors(texts[lo:hi])
                if not langs:
                    has[:] = False
                cos = v @ prototypes.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) if langs else np.zeros((hi - lo, 1))
                best = cos.argmax(axis=1)
                preds += [langs[b] if h else UNDETERMINED for b, h in zip(best, has)]
                scores += np.where(has, np.clip(cos[np.arange(hi - lo), best], 0, 1), 0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                                             names=[id_col, "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       folds: int = 3, held: int = 1, **model) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of ``docs``. Prototypes are
    learned from rows whose crc32(id) modulo ``folds`` is not ``held`` (rows with a
    null id or language teach nothing and count as not held out). Repeated rows
    each get a row; extra columns are ignored."""
    seen = F.coalesce(fold(id_col, folds) != F.lit(held), F.lit(False))
    langs, prototypes = learn_prototypes(docs, seen, id_col, text_col, lang_col, **model)
    how = {k: v for k, v in model.items() if k in ("ngram", "seed")}
    found = predict_language(docs, langs, prototypes, id_col, text_col, **how)
    return found.select(id_col, F.coalesce(fold(id_col, folds) == F.lit(held), F.lit(False)).alias("held_out"), "lang_pred", "score")


def reject_undetermined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                        folds: int = 3, held: int = 1, deviations: float = 2.0, min_grams: int = 30, **model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a determinable language.

    Texts without a letter go. So do texts that no learned profile knows: the cosine of an unrelated text with
    a prototype of ``dim`` random signs varies around 0 with deviation 1 / sqrt(dim), and a text whose best cosine stays below ``deviations``
    of those is as far from every language as a random one (an unknown script, say). Texts of fewer than ``min_grams`` n-grams
    are too short for that and stay. Where no language was learned, all texts with a letter stay.
    Rows are judged where they are read: nothing is joined or shuffled."""
    seen = F.coalesce(fold(id_col, folds) != F.lit(held), F.lit(False))
    langs, prototypes = learn_prototypes(docs, seen, id_col, text_col, lang_col, **model)
    at, known = docs.columns.index(text_col), bool(langs)
    how = {k: v for k, v in model.items() if k in ("ngram", "seed")}
    made = (prototypes.shape[1], how.get("ngram", 3), how.get("seed", 42))
    least = deviations / np.sqrt(prototypes.shape[1])

    def run(batches):
        encoder = _encoder(*made)
        for batch in batches:
            keep: list[bool] = []
            for first in range(0, batch.num_rows, 256):  # few texts at a time as Python strings
                texts = [t or "" for t in batch.column(at).slice(first, 256).to_pylist()]
                for lo, hi in _batches(texts):
                    v, has, sizes = encoder.vectors_and_sizes(texts[lo:hi])
                    if known:
                        best = (v @ prototypes.T).max(axis=1) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)
                        has &= (best >= least) | (sizes < min_grams)
                    keep += has.tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
