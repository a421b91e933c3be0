"""Hashed word features shared by the two text classifiers.

A *chunk* is a white-space separated piece of text.  Both classifiers are linear in
per-chunk features, so at scoring time every chunk is reduced to one number once, kept in
a bounded cache of the worker, and a document costs one dictionary look-up a chunk.
"""

from __future__ import annotations

import numpy as np

CACHE_LIMIT = 400_000
#: Odd multipliers of the polynomial hash and its final mixing.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class ChunkValues:
    """chunk -> float by ``values(list of chunks)``, remembered up to CACHE_LIMIT chunks."""

    def __init__(self, values, limit: int = CACHE_LIMIT):
        self.values, self.limit, self.known = values, limit, {}

    def __call__(self, chunks_of_texts: list[list[str]]) -> dict[str, float]:
        """The cache, after everything that the texts need is in it."""
        new = {c for chunks in chunks_of_texts for c in chunks if c not in self.known}
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = {c for chunks in chunks_of_texts for c in chunks}
        if new:
            new = list(new)
            self.known.update(zip(new, self.values(new).tolist()))
        return self.known


class Remembered(dict):
    """key -> solve(key), found when first asked for; keys of more than ``longest`` characters are not kept.

    At ``limit`` keys the table becomes the older one and a new one begins; what is met again moves over.
    """

    def __init__(self, solve, limit: int, longest: int):
        super().__init__()
        self.solve, self.limit, self.longest, self.older = solve, limit, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.solve(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def by_length(words: list[str]):
    """Groups of words as (places, code point matrix, lengths); long words go apart, so no matrix is much padded."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    group = np.ceil(np.log2(np.maximum(size, 8))).astype(np.int64)
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        for part in np.array_split(at, max(1, (len(at) << g) >> 20)):
            text = np.array([words[i] for i in part], dtype=f"<U{1 << g}")
            yield part, text.view(np.uint32).reshape(len(part), 1 << g).astype(np.uint64), size[part]


def grams(code: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character n-grams, one column a place, and which of them exist."""
    width = code.shape[1] - n + 1
    if width <= 0:
        return np.zeros((len(code), 0), np.uint64), np.zeros((len(code), 0), bool)
    h = np.full((len(code), width), np.uint64(n))
    for k in range(n):
        h = h * STEP + code[:, k : k + width]
    return mixed(h), np.arange(width) <= (size - n)[:, None]


def whole(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash of each word."""
    h = np.full(len(code), np.uint64(99))
    for k in range(code.shape[1]):
        h = np.where(k < size, h * STEP + code[:, k], h)
    return mixed(h)


def ragged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the rows and the row number of each element."""
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    return flat, np.repeat(np.arange(len(rows)), sizes)


def matrix(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Dense float32 rows from (distinct columns, values) pairs."""
    idx, row = ragged([r[0] for r in rows])
    out = np.zeros((len(rows), width), np.float32)
    out[row, idx] = np.concatenate([r[1] for r in rows])
    return out


class Adam:
    """Plain Adam over a list of arrays changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)


def bags(docs: list[list[str]], features, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse row of each list of words: columns and weights; the weights add up to scale unless it has no words.

    features(words) yields groups (places, columns, weights) in which each word's weights add up to 1.
    """
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in docs]
    of_word: list = [None] * len(number)
    for at, columns, weight in features(list(number)):
        for i, c, w in zip(at.tolist(), columns, weight):
            of_word[i] = c[w > 0], w[w > 0]
    out = []
    for words in docs:
        if not len(words):
            out.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        kinds, times = np.unique(words, return_counts=True)
        flat, row = ragged([of_word[i][0] for i in kinds])
        weight = np.concatenate([of_word[i][1] for i in kinds]) * times[row]
        idx, inverse = np.unique(flat, return_inverse=True)
        out.append((idx, (np.bincount(inverse, weights=weight) * (scale / len(words))).astype(np.float32)))
    return out


def in_slices(texts, chars: int = 1_000_000):
    """Consecutive slices (start, texts) of about so many characters; nulls become empty texts."""
    part, size, start = [], 0, 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        part.append(t)
        size += len(t)
        if size >= chars:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part
