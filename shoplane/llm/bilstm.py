"""A small bidirectional LSTM that labels the blocks of a page (numpy).

A block's input is the mean vector of its hashed path words, the mean vector of
its hashed text words, and a few sizes. Two LSTMs read the page forwards and
backwards; a logistic unit over both states labels each block with the whole
page as context. Trained by back-propagation through time with Adam.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

from shoplane.llm.html_blocks import Path, inherited

PATH_BUCKETS, WORD_BUCKETS = 512, 512
PATH_DIM, WORD_DIM, HIDDEN, EXTRA = 16, 8, 16, 5


def bag(words, buckets: int) -> list[int]:
    return [crc32(w if isinstance(w, bytes) else w.encode()) % buckets for w in words]


def inputs(page) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Hashed path words, hashed text words and sizes of a page's blocks."""
    paths = [bag(p, PATH_BUCKETS) for p, _ in page]
    words = [bag(t.lower().encode().split(), WORD_BUCKETS) for _, t in page]
    extra = sizes([t for _, t in page], words, ["a" in p for p, _ in page])
    return paths, words, extra


def sizes(texts: list[str], words: list[list[int]], linked: list[bool]) -> np.ndarray:
    n = len(texts)
    return np.array([[min(len(w), 100) / 50, min(len(t), 600) / 300, k / n, float(a), float(t[-1] in ".!?")]
                     for k, (t, w, a) in enumerate(zip(texts, words, linked))], np.float32).reshape(n, EXTRA)


def means(bags: list[list[int]], buckets: int) -> np.ndarray:
    """Rows of bucket frequencies, each summing to 1 (0 for an empty bag)."""
    counts = np.fromiter(map(len, bags), np.int64, len(bags))
    flat = np.fromiter((i for b in bags for i in b), np.int64, int(counts.sum()))
    at = np.repeat(np.arange(len(bags)), counts) * buckets + flat
    out = np.bincount(at, minlength=len(bags) * buckets).reshape(-1, buckets).astype(np.float32)
    return out / np.maximum(counts, 1)[:, None].astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + EXTRA
        self.w = {"path": r.normal(0, 0.5, (PATH_BUCKETS, PATH_DIM)), "word": r.normal(0, 0.5, (WORD_BUCKETS, WORD_DIM)),
                  "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in "fb":
            self.w["x" + side] = r.normal(0, d**-0.5, (d, 4 * HIDDEN))
            self.w["h" + side] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.w["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _scan(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = True):
        """States (steps x pages x hidden) of one direction; x is steps first. ``keep`` what the gradient needs."""
        steps, n, _ = x.shape
        pre = x @ self.w["x" + side] + self.w["c" + side]
        h = c = np.zeros((n, HIDDEN), np.float32)
        kept, out = [], np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w["h" + side]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                kept.append((t, i, f, o, g, c, squashed, h, on))
            c = np.where(on, new, c)
            h = np.where(on, o * squashed, h)
            out[t] = h
        return out, kept

    def _back(self, x, grad_out, keep, side, grads):
        grad_x = np.zeros_like(x)
        n = x.shape[1]
        dh = dc = np.zeros((n, HIDDEN), np.float32)
        for t, i, f, o, g, c, squashed, h, on in reversed(keep):
            dh = dh + grad_out[t]
            dh_on, dc_on = np.where(on, dh, 0), np.where(on, dc, 0)
            inner = dc_on + dh_on * o * (1 - squashed**2)
            dz = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), dh_on * squashed * o * (1 - o), inner * i * (1 - g**2)], axis=1)
            grads["x" + side] += x[t].T @ dz
            grads["h" + side] += h.T @ dz
            grads["c" + side] += dz.sum(axis=0)
            grad_x[t] = dz @ self.w["x" + side].T
            dh = np.where(on, dz @ self.w["h" + side].T, dh)
            dc = np.where(on, inner * f, dc)
        return grad_x

    def _pad(self, lengths: list[int], blocks: np.ndarray):
        """One padded batch of the blocks' inputs (steps x pages x ...), mask, owner index."""
        at = np.concatenate([np.arange(s) for s in lengths]), np.repeat(np.arange(len(lengths)), lengths)
        x = np.zeros((max(lengths), len(lengths), PATH_DIM + WORD_DIM + EXTRA), np.float32)
        x[at] = blocks
        mask = np.zeros(x.shape[:2], bool)
        mask[at] = True
        return x, mask, at

    def _bags(self, pages):
        """(inputs of all blocks, path bags, word bags)."""
        path = means([b for p in pages for b in p[0]], PATH_BUCKETS)
        word = means([b for p in pages for b in p[1]], WORD_BUCKETS)
        return np.hstack([path @ self.w["path"], word @ self.w["word"], np.vstack([p[2] for p in pages])]), path, word

    def _probabilities(self, lengths: list[int], blocks: np.ndarray) -> list[np.ndarray]:
        x, mask, at = self._pad(lengths, blocks)
        states = np.concatenate([self._scan(x, mask, s, keep=False)[0] for s in "fb"], axis=2)
        p = _sigmoid(states @ self.w["out"] + self.w["bias"])[at]
        return np.split(p, np.cumsum(lengths)[:-1])

    def predict(self, pages) -> list[np.ndarray]:
        """Probability of main text for each block of each (non-empty) page."""
        return self._probabilities([len(p[0]) for p in pages], self._bags(pages)[0])

    def predict_paths(self, pages: list[list[tuple[Path, str]]]) -> list[np.ndarray]:
        """``predict`` for ``leaf_blocks``: a path's sum of vectors is its parent's and its own words', and words' vectors are added up
        block by block, so a page costs its words and elements, however deep it is."""
        start = (np.zeros(PATH_DIM, np.float32), False)

        def below(value, words):
            return value[0] + self.w["path"][bag(words, PATH_BUCKETS)].sum(axis=0), value[1] or "a" in words

        made = []
        for page in pages:
            paths, texts = zip(*page)
            above = inherited(list(paths), start, below)
            path = np.array([v for v, _ in above]) / np.maximum([p.size for p in paths], 1)[:, None]
            words = [bag(t.lower().encode().split(), WORD_BUCKETS) for t in texts]
            counts = np.array([len(w) for w in words])
            flat = np.fromiter((i for w in words for i in w), np.int64, int(counts.sum()))
            word = np.add.reduceat(self.w["word"][flat], np.cumsum(counts) - counts) / counts[:, None]
            made.append(np.hstack([path, word, sizes(list(texts), words, [a for _, a in above])]).astype(np.float32))
        return self._probabilities([len(p) for p in pages], np.vstack(made))

    def gradients(self, pages, labels):
        """(mean loss, gradients) of one batch."""
        blocks, path, word = self._bags(pages)
        x, mask, at = self._pad([len(p[0]) for p in pages], blocks)
        (hf, kf), (hb, kb) = (self._scan(x, mask, s) for s in "fb")
        states = np.concatenate([hf, hb], axis=2)
        y = np.concatenate(labels).astype(np.float32)
        p = _sigmoid(states @ self.w["out"] + self.w["bias"])[at]
        loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        d = np.zeros(mask.shape, np.float32)
        d[at] = (p - y) / len(y)
        grads["out"] = np.einsum("tn,tnk->k", d, states)
        grads["bias"] = d.sum(keepdims=True).reshape(1)
        ds = d[:, :, None] * self.w["out"]
        gx = self._back(x, ds[:, :, :HIDDEN], kf, "f", grads) + self._back(x, ds[:, :, HIDDEN:], kb, "b", grads)
        flat = gx[at]
        grads["path"] = path.T @ flat[:, :PATH_DIM]
        grads["word"] = word.T @ flat[:, PATH_DIM:PATH_DIM + WORD_DIM]
        return loss, grads

    def train(self, batches, rounds: int = 6, rate: float = 0.02, decay: float = 1e-4) -> float:
        """Adam over ``batches(round)``, an iterable of (pages, labels); the last loss."""
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        step, loss = 0, 0.0
        for r in range(rounds):
            for pages, labels in batches(r):
                step += 1
                loss, grads = self.gradients(pages, labels)
                for k, g in grads.items():
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return float(loss)
