"""Quality classifier: a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad from its own and its neighbours'
features and the labels' transitions. Forward-backward gives each line's
probability of being good; their mean, weighted by line length, is the document's
score. Training lines take their document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.llm.common import bounded_sample, fold

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
N_FEATURES = 11
#: Documents handled at once.
_GROUP = 512


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, code points) of the lines that have a word."""
    lines = [x for x in text.split(b"\n") if x.split()]
    rows, sizes, seen = [], [], {}
    for x in lines:
        words = x.split()
        n, w = len(x), len(words)
        upper, digits, symbols = (n - len(x.translate(None, c)) for c in (_UPPER, _DIGITS, _SYMBOLS))
        letters = upper + n - len(x.translate(None, _LOWER))
        black = sum(map(len, words))
        end = words[-1][-1:]
        seen[x] = seen.get(x, 0) + 1
        rows.append((upper / max(letters, 1), digits / black, min(symbols / w, 2.0), min(x.count(b"!") / w, 2.0), min(x.count(b"|") / w, 1.0),
                     len(set(words)) / w, min(w / 50, 1.0), float(end in b".?!"), float(seen[x] > 1), min(black / w / 10, 2.0), letters / black))
        sizes.append(len(x.decode(errors="replace")))
    return np.array(rows, np.float32).reshape(-1, N_FEATURES), np.array(sizes, np.float64)


def with_neighbours(f: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and after (0 at the ends), and 1."""
    pad = np.zeros((1, f.shape[1]), f.dtype)
    return np.hstack([f, np.vstack([pad, f[:-1]]), np.vstack([f[1:], pad]), np.ones((len(f), 1), f.dtype)])


@dataclass
class Crf:
    """weights: good minus bad per feature; start: per state; move: from state to state (0 bad, 1 good)."""
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std) @ self.weights


def forward_backward(unary: np.ndarray, mask: np.ndarray, start: np.ndarray, move: np.ndarray):
    """(marginals of good, log Z, expected moves) of a padded batch (documents x lines)."""
    n, steps = unary.shape
    u = np.stack([np.zeros_like(unary), unary], axis=2)
    alpha = np.empty((steps, n, 2))
    alpha[0] = start + u[:, 0]
    for t in range(1, steps):
        a = np.logaddexp(alpha[t - 1][:, :1] + move[0], alpha[t - 1][:, 1:] + move[1]) + u[:, t]
        alpha[t] = np.where(mask[:, t, None], a, alpha[t - 1])
    log_z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    beta = np.zeros((steps, n, 2))
    moves = np.zeros((n, 2, 2))
    for t in range(steps - 1, 0, -1):
        on = u[:, t] + beta[t]
        pair = alpha[t - 1][:, :, None] + move + on[:, None, :] - log_z[:, None, None]
        moves += np.where(mask[:, t, None, None], np.exp(np.minimum(pair, 0)), 0)
        b = np.logaddexp(move[:, 0] + on[:, :1], move[:, 1] + on[:, 1:])
        beta[t - 1] = np.where(mask[:, t, None], b, beta[t])
    both = alpha + beta - log_z[None, :, None]
    good = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -500, 500)))
    return good.T, log_z, moves


def padded(seqs: list[np.ndarray]):
    """Index groups of sequences of like length, padded: (indices, values, mask)."""
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    lo = 0
    while lo < len(order):
        first, hi = len(seqs[order[lo]]), lo + 1
        while hi < len(order) and len(seqs[order[hi]]) <= max(2, 1.25 * first):
            hi += 1
        idx = order[lo:hi]
        steps = max(len(seqs[i]) for i in idx)
        value, mask = np.zeros((len(idx), steps, *seqs[0].shape[1:])), np.zeros((len(idx), steps), bool)
        for k, i in enumerate(idx):
            value[k, :len(seqs[i])], mask[k, :len(seqs[i])] = seqs[i], True
        yield idx, value, mask
        lo = hi


def train(seqs: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.1, l2: float = 1e-3) -> Crf:
    """Penalised maximum likelihood by Adam; every document weighs the same."""
    x = np.vstack(seqs) if seqs else np.zeros((1, 3 * N_FEATURES + 1))
    mean, std = x.mean(axis=0), x.std(axis=0)
    mean[-1], std = 0.0, np.where(std > 1e-6, std, 1.0)
    k = x.shape[1]
    theta, m, v = np.zeros(k + 6), np.zeros(k + 6), np.zeros(k + 6)
    groups = [(np.array(labels)[idx], (value - mean) / std, mask) for idx, value, mask in padded(seqs)] if seqs else []
    for step in range(1, rounds + 1):
        grad = -l2 * theta
        for y, value, mask in groups:
            good, _, moves = forward_backward(value @ theta[:k], mask, theta[k:k + 2], theta[k + 2:].reshape(2, 2))
            weight = 1 / (mask.sum(axis=1) * len(seqs))
            grad[:k] += np.einsum("nt,ntk->k", (y[:, None] - good) * mask * weight[:, None], value)
            start = np.stack([1 - good[:, 0], good[:, 0]], axis=1)
            grad[k:k + 2] += ((np.eye(2)[y] - start) * weight[:, None]).sum(axis=0)
            seen = np.zeros_like(moves)
            seen[np.arange(len(y)), y, y] = mask.sum(axis=1) - 1
            grad[k + 2:] += ((seen - moves) * weight[:, None, None]).sum(axis=0).ravel()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(mean, std, theta[:k], theta[k:k + 2], theta[k + 2:].reshape(2, 2))


def score_texts(texts: list[bytes], model: Crf) -> list[float]:
    """Length-weighted mean probability of the good label; 0 for texts without a word."""
    made = [line_features(t) for t in texts]
    has = [i for i, (f, _) in enumerate(made) if len(f)]
    out = [0.0] * len(texts)
    if has:
        unary = [model.unary(with_neighbours(made[i][0])) for i in has]
        for idx, value, mask in padded(unary):
            good, _, _ = forward_backward(value, mask, model.start, model.move)
            for k, j in enumerate(idx):
                sizes = made[has[j]][1]
                out[has[j]] = float(np.clip(good[k, :len(sizes)] @ sizes / sizes.sum(), 0, 1))
    return out


def fit(docs: DataFrame, labels: DataFrame, where: Column, fit_docs: int, id_col: str = "doc_id", text_col: str = "text",
        quality_col: str = "quality", fit_bytes: int = 64 << 20, **training) -> Crf:
    """The CRF from at most ``fit_docs`` distinct labelled documents that ``where`` admits, and ``fit_bytes`` of text
    (lowest id hash first). An id with contradictory labels teaches nothing. Line features are made on the executors."""
    label = F.col(quality_col).cast("int")
    chosen = (labels.where(where & F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id"))
              .agg(F.min(label).alias("y"), F.max(label).alias("other")).where("(y > 0) = (other > 0)").select("l_id", "y")
              .orderBy(F.xxhash64("l_id"), "l_id").limit(fit_docs))
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("t"))
    rows = rows.join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("d_id", "y", "t")
    rows = bounded_sample(rows, "d_id", "t", fit_docs, fit_bytes).select("d_id", "y", "t")

    def run(batches):
        for batch in batches:
            made = [line_features(t.as_py() or b"")[0] for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([f.tobytes() for f in made], pa.binary())],
                                             names=["d", "y", "f"])

    got = sorted(rows.mapInArrow(run, "d string, y int, f binary").collect(), key=lambda r: (r.d, r.y, bytes(r.f)))
    seqs = [(np.frombuffer(bytes(r.f), np.float32).reshape(-1, N_FEATURES), int(r.y > 0)) for r in got]
    seqs = [(with_neighbours(f), y) for f, y in seqs if len(f)]
    return train([f for f, _ in seqs], [y for _, y in seqs], **training)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2,
             threshold: float = 0.7, fit_docs: int = 2500, **training) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``. Labels of rows
    whose crc32(id) modulo ``folds`` is ``held`` are never read, nor null ones.
    Null and wordless texts score 0; without labels every line scores 0.5; repeated
    rows each get a row; extra columns are ignored."""
    model = fit(docs, labels, F.coalesce(fold(id_col, folds) != F.lit(held), F.lit(False)), fit_docs, id_col, text_col, **training)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            scores: list[float] = []
            for lo in range(0, len(texts), _GROUP):
                scores += score_texts([t.as_py() or b"" for t in texts[lo:lo + _GROUP]], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    scored = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
    return scored.select(id_col, F.coalesce(fold(id_col, folds) == F.lit(held), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"))
