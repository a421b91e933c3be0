"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector w, shared by all grades,
over hashed text features, and ordered thresholds.  Scores are the expected grade and tail
probabilities P(grade >= g), by which documents are selected.

Features of a white-space separated chunk: its bare lower-cased word, its shape (runs of
capitals, small letters and digits become one sign each, all else stays) and whether it
repeats the chunk before; a text is the mean over its chunks.

Defined results: a null text counts as empty; a text without chunks is rated by the thresholds
alone; null grades and grades of missing documents teach nothing; several ratings of a document
count as their largest; with fewer than two grades present every text gets the one grade (0 if none).
Extra columns are ignored by fit and kept by rate; repeated rows give repeated results.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import collect_bags, sample
from .toxicity import bare
from .wordbag import Adam, ChunkValues, bags, by_length, in_slices, matrix, whole

BITS = 13
EPOCHS = 20
BATCH = 128
RATE = 0.03
SCALE = 8.0
L2 = 3e-4
#: At most so many rated documents are used for training, those with the smallest hash of doc_id.
TRAIN_ROWS = 5000
#: Column of "repeats the chunk before", after the hashed ones.
REPEAT = 1 << BITS
SHAPES = ((re.compile(r"[^\W\d_a-zà-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "9"))


def shape(chunk: str) -> str:
    """'Hello,' -> 'Aa,'; 'OF!!' -> 'A!!'; letters that are neither Latin-1 small nor decided otherwise count as capitals."""
    for pattern, sign in SHAPES:
        chunk = pattern.sub(sign, chunk)
    return chunk


def columns(chunks: list[str]):
    """Groups of chunks as (places, their two columns, weights of a half each)."""
    both = np.zeros((len(chunks), 2), np.int64)
    for j, words in enumerate((bare(chunks), list(map(shape, chunks)))):
        for at, code, size in by_length(words):
            both[at, j] = (whole(code, size) + np.uint64(j)) & np.uint64((1 << BITS) - 1)
    same = both[:, 0] == both[:, 1]
    weight = np.where(same[:, None], [1.0, 0.0], [0.5, 0.5])
    yield np.arange(len(chunks)), both, weight


def repeats(chunks: list[str]) -> float:
    """Share of the chunks that equal the one before."""
    return sum(map(str.__eq__, chunks, chunks[1:])) / max(len(chunks), 1)


def text_bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    split = [t.split() for t in texts]
    return [(np.append(i, REPEAT), np.append(v, np.float32(SCALE * repeats(c)))) for (i, v), c in zip(bags(split, columns, SCALE), split)]


class Model:
    """weights: of the columns; thresholds: ascending, one fewer than grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.value = ChunkValues(self._values)

    def __reduce__(self):
        return Model, (self.weights, self.thresholds)

    def _values(self, chunks: list[str]) -> np.ndarray:
        ((_, both, weight),) = columns(chunks)
        return (self.weights[both] * weight).sum(1)

    def tails(self, texts) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each text."""
        margin = np.zeros(len(texts))
        for start, part in in_slices(texts):
            split = [t.split() for t in part]
            value = self.value(split)
            for i, c in enumerate(split, start):
                if c:
                    margin[i] = SCALE * (sum(map(value.__getitem__, c)) / len(c) + self.weights[REPEAT] * repeats(c))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades, n_grades: int, seed: int = 7) -> Model:
    """Maximum likelihood by mini-batches of Adam; thresholds stay ordered as a first one and positive steps."""
    grades = np.asarray(grades, np.int64)
    kinds = np.unique(grades)
    if len(kinds) < 2:
        only = int(kinds[0]) if len(kinds) else 0
        return Model(np.zeros(REPEAT + 1, np.float32), np.where(np.arange(1, n_grades) <= only, -50.0, 50.0))
    w = np.zeros(REPEAT + 1, np.float32)
    below = (np.array([(grades < k).sum() for k in range(1, n_grades)]) + 0.5) / (len(grades) + 1)
    start = np.log(below / (1 - below))
    free = np.append(start[:1], np.log(np.maximum(np.diff(start), 1e-3)))
    adam, rng = Adam([w, free], RATE), np.random.default_rng(seed)
    order_matrix = np.tril(np.ones((n_grades - 1, n_grades - 1)))
    for epoch in range(EPOCHS):
        adam.rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y = matrix([rows[i] for i in pick], len(w)), grades[pick]
            steps = np.append(free[:1], np.exp(free[1:]))
            cut = np.concatenate([[-np.inf], order_matrix @ steps, [np.inf]])
            margin = x @ w
            up, low = (1 / (1 + np.exp(-np.clip(cut[k] - margin, -40, 40))) for k in (y + 1, y))
            up, low = np.where(y == n_grades - 1, 1.0, up), np.where(y == 0, 0.0, low)
            p = np.maximum(up - low, 1e-9)
            d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
            g_cut = np.zeros(n_grades + 1)
            np.add.at(g_cut, y + 1, -d_up)
            np.add.at(g_cut, y, d_low)
            g_steps = order_matrix.T @ g_cut[1:-1] / len(pick)
            g_free = np.append(g_steps[:1], g_steps[1:] * steps[1:])
            adam.step([(x.T @ (d_up - d_low).astype(np.float32)) / len(pick) + L2 * w, g_free])
    return Model(w, order_matrix @ np.append(free[:1], np.exp(free[1:])))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, rows: int = TRAIN_ROWS) -> Model:
    """A model from ratings(doc_id, grade), grades 0 to n_grades - 1; others are clipped to that range."""
    graded = ratings.where("doc_id is not null and grade is not null")
    graded = graded.groupBy("doc_id").agg(F.max(F.least(F.greatest(F.col("grade").cast("int"), F.lit(0)), F.lit(n_grades - 1))).alias("target"))
    targets, bagged = collect_bags(sample(docs, graded, rows), text_bags)
    return train(bagged, targets, n_grades)


def tail_probabilities(model: Model, text: Column) -> Column:
    """array<double>: P(grade >= 1), P(grade >= 2), ..."""

    @F.pandas_udf("array<double>")
    def tails(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.tails(texts.tolist())))

    return tails(text)


def rate(docs: DataFrame, model: Model, text: str = "text", out: str = "rated") -> DataFrame:
    """docs with a struct ``out``: expected_grade and tails; a column of that name is replaced."""
    got = docs.withColumn(out, tail_probabilities(model, F.col(text)))
    return got.withColumn(out, F.struct(F.aggregate(out, F.lit(0.0), lambda a, x: a + x).alias("expected_grade"), F.col(out).alias("tails")))


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from the 0/1 labels: 0 of low quality, 1 of good quality but toxic, 2 good."""
    return labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2).alias("grade"),
    )
