"""Exact top-k inner products over norm-sorted vectors.

A shard's vectors are held by descending length, rotated by the right singular vectors of the
whole table (from its d x d Gram matrix, summed over all rows).  Queries of a block take them
in runs: a run is left, and with it all that follow, when the query's length times the run's
largest length cannot reach its k-th best score; the first HEAD rotated coordinates give a
partial sum and Cauchy-Schwarz bounds the rest by the product of the residual lengths; only
vectors whose bound reaches the k-th best are scored exactly: doubles hold integers below 2^53 as
they are, and where lengths allow larger products all are made of Python's integers.

Components x become floor(256 x).  Defined results: vectors null, empty or with a null or
non-finite component take no part; vectors only meet those of their own length; fewer than k
candidates are all returned; equal scores go to the smaller vec_id; repeated rows are separate
candidates, except that a query never finds its own id; extra columns are ignored; an empty table
gives no rows; components of 2^54 or more, and scores that a long can't hold, raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage
from .vectors import against_queries, ranked, sharded, usable

SHARD_ROWS, RUN, HEAD_SHARE, SCALE = 4096, 512, 0.5, 256
#: Added to every bound: more than the rounding of the rotated sums, relative to the lengths' product.
SLACK = 1e-9


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of each length's table, strongest first; the driver sees one d x d matrix a length and partition."""

    def gram(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = np.stack(part.v).astype(np.float64)
                total[dim] = total.get(dim, 0) + x.T @ x
        if total:
            yield pd.DataFrame({"dim": list(total), "at": [list(range(d * d)) for d in total], "value": [g.ravel() for g in total.values()]})

    cells = vectors.mapInPandas(gram, "dim int, at array<int>, value array<double>")
    cells = cells.select("dim", F.explode(F.arrays_zip("at", "value")).alias("c")).groupBy("dim", "c.at").agg(F.sum("c.value").alias("value"))
    out = {}
    for dim, part in cells.toPandas().groupby("dim"):
        g = part.sort_values("at").value.to_numpy().reshape(dim, dim)
        _, vectors_ = np.linalg.eigh((g + g.T) / 2)
        out[int(dim)] = vectors_[:, ::-1].copy()
    return out


def best_of_large(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The same as best() by Python's integers, RUN rows at a time."""
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    rows = []
    for name, vector in zip(q_ids.tolist(), whole(q)):
        top: list[tuple[int, int]] = []
        for at in range(0, len(x), RUN):
            scores = whole(x[at : at + RUN]) @ vector
            top = sorted(top + [(-s, i) for s, i in zip(scores.tolist(), ids[at : at + RUN].tolist()) if i != name])[:k]
        rows += [(name, i, -s) for s, i in top]
    if any(abs(s) >= 1 << 63 for _, _, s in rows):
        raise OverflowError("a score does not fit a long")
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def best(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, turn: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of x (ids; by descending length) for each query."""
    head = max(1, int(len(turn) * HEAD_SHARE))
    xr, qr = x @ turn, q @ turn
    length, q_length = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    rest, q_rest = np.sqrt((xr[:, head:] ** 2).sum(1)), np.sqrt((qr[:, head:] ** 2).sum(1))
    if length.max(initial=0) * q_length.max(initial=0) >= 2.0**52:
        return best_of_large(ids, x, q_ids, q, k)
    score = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for at in range(0, len(x), RUN):
        run = slice(at, at + RUN)
        slack = SLACK * (1 + q_length * length[at])
        live = live[(q_length * length[at] + slack)[live] >= score[live, -1]]
        if not len(live):
            break
        bound = qr[live, :head] @ xr[run, :head].T + q_rest[live, None] * rest[None, run] + slack[live, None]
        hit = (bound >= score[live, -1:]) & (q_ids[live, None] != ids[None, run])
        some = np.flatnonzero(hit.any(0))
        exact = np.where(hit[:, some], q[live] @ x[run][some].T, -np.inf)
        cand = np.concatenate([score[live], exact], 1)
        names = np.concatenate([who[live], np.broadcast_to(ids[run][some], exact.shape)], 1)
        order = np.lexsort((names, -cand), axis=1)[:, :k]
        score[live], who[live] = np.take_along_axis(cand, order, 1), np.take_along_axis(names, order, 1)
    i, j = np.nonzero(np.isfinite(score))
    return pd.DataFrame({"query_id": q_ids[i], "vec_id": who[i, j], "score": np.rint(score[i, j]).astype(np.int64)})


def top(table: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products with table(vec_id, embedding) for each row of queries."""

    def scaled(x):
        return F.when(F.abs(x) < 2.0**54, F.floor(x * SCALE).cast("double")).otherwise(F.raise_error(F.lit("a component is too large")).cast("double"))

    def whole(rows: DataFrame) -> DataFrame:
        return usable(rows, False).withColumn("v", F.transform("v", scaled))

    vectors = whole(table)
    turns = rotation(vectors)

    def held(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf.v).astype(np.float64), pdf.id.to_numpy(np.int64)
        order = np.lexsort((ids, -(x * x).sum(1)))
        return pd.DataFrame({"dim": [pdf.dim.iloc[0]], "shard": [pdf.shard.iloc[0]], "shards": [pdf.shards.iloc[0]], "ids": [ids[order].tobytes()], "vectors": [x[order].tobytes()]})

    def one(row, q_ids, q):
        ids = np.frombuffer(row.ids, np.int64)
        return best(ids, np.frombuffer(row.vectors).reshape(len(ids), row.dim), q_ids, q, turns[row.dim], k)

    shards = cut_lineage(sharded(vectors, SHARD_ROWS).groupBy("dim", "shard").applyInPandas(held, "dim int, shard int, shards int, ids binary, vectors binary"))
    found = against_queries(shards, whole(queries), one, "query_id long, vec_id long, score long")
    return ranked(found, k, [F.desc("score")])
