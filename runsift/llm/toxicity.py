"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Every word is a bag of its character n-grams and itself, hashed into embedding rows;
a text is the mean of its words' vectors, and a linear softmax on that mean gives the
probability of label 1.  Embeddings and softmax are trained jointly in numpy, so an
unseen misspelling lands near the words whose n-grams it shares.  After each step every row of
the embedding is drawn towards zero by the same length (a group lasso), so rows that tell
little vanish and the model can't learn texts by heart.

Defined results: a null text counts as empty, whole texts of any length are read; a text without words scores the trained
prior (softmax of the bias alone); labels that are null, or of documents that are
missing, teach nothing; several label rows of a document teach the larger label once;
with no usable label, or labels of one kind only, every text scores that kind's smoothed share.
Extra columns of the inputs are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import collect_bags, sample
from .wordbag import Adam, ChunkValues, bags, by_length, grams, in_slices, matrix, whole

BITS = 14
DIM = 12
EPOCHS = 15
#: Small training sets get as many more epochs as make so many steps.
LEAST_STEPS = 300
BATCH = 128
RATE = 0.03
#: The mean of a text's words is scaled by this.
SCALE = 150.0
#: Label 1 is rare; its documents weigh this much in training.
POSITIVE = 3.0
#: How far a row of the embedding is drawn towards zero in a step, as a multiple of the rate.
SHRINK = 1.0
#: At most so many labelled documents are used for training, those with the smallest hash of doc_id.
TRAIN_ROWS = 6000
#: Taken off a word's ends.
STRIP = "\"'`.,;:!?()[]{}<>|*_-+=/\\~^&%$#@"


def bare(chunks: list[str]) -> list[str]:
    return [f"<{c.lower().strip(STRIP)}>" for c in chunks]


def subwords(words: list[str]):
    """Groups of words as (places, embedding rows of their n-grams, weights that add up to 1 a word)."""
    for at, code, size in by_length(words):
        parts = [(whole(code, size)[:, None], np.ones((len(at), 1), bool))]
        parts += [grams(code, size, n) for n in (3, 4, 5)]
        there = np.concatenate([p[1] for p in parts], 1)
        rows = (np.concatenate([p[0] for p in parts], 1) & np.uint64((1 << BITS) - 1)).astype(np.int32)
        yield at, rows, there / there.sum(1, keepdims=True)


def text_bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    return bags([[w for w in bare(t.split()) if len(w) > 2] for t in texts], subwords, SCALE)


class Model:
    """margin: what a row of the embedding adds to logit 1 minus logit 0."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.margin, self.bias = margin, bias
        self.value = ChunkValues(self._values)

    def __reduce__(self):
        return Model, (self.margin, self.bias)

    def _values(self, chunks: list[str]) -> np.ndarray:
        words, out = bare(chunks), np.zeros(len(chunks))
        for at, rows, weight in subwords(words):
            out[at] = (self.margin[rows] * weight).sum(1)
        out[[len(w) <= 2 for w in words]] = np.nan
        return out

    def score(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for start, part in in_slices(texts):
            chunks = [t.split() for t in part]
            value = self.value(chunks)
            for i, c in enumerate(chunks, start):
                v = np.fromiter(map(value.__getitem__, c), np.float64, len(c))
                v = v[~np.isnan(v)]
                if len(v):
                    out[i] += SCALE * v.mean()
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels, seed: int = 7) -> Model:
    """Joint training of embeddings (2^BITS x DIM) and softmax (DIM x 2) by mini-batches of Adam."""
    labels = np.asarray(labels, np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), prior)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.array([0, prior], np.float32)
    adam = Adam([emb, soft, bias], RATE)
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(rows) // BATCH)))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x = matrix([rows[i] for i in pick], 1 << BITS)
            hidden = x @ emb
            logit = hidden @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= np.where(labels[pick] == 1, POSITIVE, 1.0)[:, None] / len(pick)
            adam.step([x.T @ (p @ soft.T), hidden.T @ p, p.sum(0)])
            length = np.sqrt((emb * emb).sum(1, keepdims=True))
            emb *= np.maximum(0, 1 - SHRINK * adam.rate / np.maximum(length, 1e-9))
    return Model(emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of doc_id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labels(doc_id, toxic) of documents that are not held out."""
    graded = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    graded = graded.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("target"))
    targets, bagged = collect_bags(sample(docs, graded, rows), text_bags)
    return train(bagged, (targets > 0).astype(int))


def probability(model: Model, text: Column) -> Column:
    """The probability of label 1, from the whole text alone."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return scored(text)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 in column ``out``; a column of that name is replaced."""
    return docs.withColumn(out, probability(model, F.col(text)))
