"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Each shard of about SHARD_ROWS rows is a graph of layers over its distinct vectors; all ids of a
vector are kept sorted beside it, and a vector that is found stands for all of them.  A vector's
top layer is drawn from a geometric law by a hash of its smallest id, and vectors enter in order of
falling top layer, BLOCK at a time.  A new vector's candidates are what a beam search of the graph so
far gives, entered at the nearest vector of the layer above, and the vectors of its own block; it is
linked with those that the diversity rule keeps (a candidate must be nearer to the new vector than
to every neighbour kept before), both ways, and a full list is pruned by the same rule.  The graph
is stored as flat neighbour arrays (-1: none).  Queries of a block descend together: greedy steps
on the upper layers, a beam of EF on layer 0.  The best of all shards are merged and scored in
double precision; every vector is indexed.

Defined results: vectors null, empty, zero or with a null or non-finite component take no part;
vectors only meet those of their own length; fewer than k candidates are all returned; equal
distances go to the smaller vec_id; repeated rows are separate candidates with one id, except
that a query never finds its own id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage
from .vectors import against_queries, ranked, sharded, usable

SHARD_ROWS, BLOCK, M, CANDIDATES, EF = 8192, 512, 16, 32, 96


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0)


def diverse(x: np.ndarray, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Links of some rows: the diversity rule over their candidates ``near`` (-1: none) at distances ``dist``, both ascending by distance.

    What the rule leaves out fills up free places, nearest first.
    """
    n, width = near.shape
    chosen = np.zeros((n, width), bool)
    for at in range(0, n, BLOCK):
        part = slice(at, at + BLOCK)
        c = x[near[part]]
        sq = (c * c).sum(2)
        between = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1)), 0)
        free, rows = near[part] >= 0, np.arange(len(c))
        for _ in range(most):
            first = free.argmax(1)
            some = free[rows, first]
            if not some.any():
                break
            chosen[at + rows[some], first[some]] = True
            free &= between[rows, first] > dist[part]
            free[rows, first] = False
    # Chosen ones first, then the others, each nearest first.
    order = np.argsort(np.where(near < 0, 2, ~chosen), axis=1, kind="stable")[:, :most]
    out = np.full((n, most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, 1)
    return out


def levels(ids: np.ndarray) -> np.ndarray:
    """Top layer of each id: floor(-ln(u) / ln(M)) with u from a hash."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(u) / np.log(M)).astype(int)


def build_layer(x: np.ndarray, most: int, entry: np.ndarray) -> np.ndarray:
    """Neighbour array (len(x) x most) of one layer, -1 for free places; the search for row i enters at row entry[i] < i."""
    n = len(x)
    links = np.full((n, most), -1, np.int32)
    for at in range(0, n, BLOCK):
        new = np.arange(at, min(at + BLOCK, n))
        own = distances(x[new], x[new])
        own[np.triu_indices(len(new))] = np.inf  # only earlier ones of the block
        near, dist = np.broadcast_to(new.astype(np.int32), own.shape), own
        if at:
            place, far = beam(x[:at], x[new], links[:at], np.minimum(entry[new], at - 1), CANDIDATES)
            near, dist = np.concatenate([place, near], 1), np.concatenate([far, dist], 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :CANDIDATES]
        near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
        near = np.where(np.isfinite(dist), near, -1)
        links[new, : min(M, most)] = diverse(x, near, dist, min(M, most))
        add_back(x, links, new)
    return links


def add_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Links from the neighbours of ``new`` back to them; lists that overflow are pruned."""
    most = links.shape[1]
    i, j = np.nonzero(links[new] >= 0)
    to, of = new[i].astype(np.int32), links[new][i, j]
    order = np.argsort(of, kind="stable")
    to, of = to[order], of[order]
    nodes, first, times = np.unique(of, return_index=True, return_counts=True)
    had = (links[nodes] >= 0).sum(1)
    fits = had + times <= most
    rank = np.arange(len(of)) - np.repeat(first, times)
    easy = np.repeat(fits, times)
    links[of[easy], (np.repeat(had, times) + rank)[easy]] = to[easy]
    full = np.flatnonzero(~fits)
    if not len(full):
        return
    wide = np.full((len(full), most + int(times[full].max())), -1, np.int32)
    wide[:, :most] = links[nodes[full]]
    at = np.full(len(nodes), -1)
    at[full] = np.arange(len(full))
    wide[np.repeat(at, times)[~easy], most + rank[~easy]] = to[~easy]
    for part in range(0, len(full), BLOCK):
        rows, near = nodes[full][part : part + BLOCK], wide[part : part + BLOCK]
        dist = ((x[near] - x[rows][:, None, :]) ** 2).sum(2)
        dist[near < 0] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")
        near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
        links[rows] = diverse(x, near, dist, most)


def distinct(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, distinct rows of x) for ascending ids: those of row g are ids[starts[g] : starts[g + 1]], ascending."""
    x = x + 0.0  # makes -0.0 equal to 0.0 bit by bit
    group, _ = pd.factorize(np.array([row.tobytes() for row in x], object))
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(group.max() + 2))
    return ids[order], starts, x[order[starts[:-1]]]


def build(ids: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the bottom: (members as rows of x, their neighbour array as positions within members); an upper layer's members come first in the one below."""
    top = levels(ids)
    order = np.lexsort((np.arange(len(ids)), -top)).astype(np.int32)
    out: list = []
    for layer in range(int(top.max()), -1, -1):
        member = order[: int((top >= layer).sum())]
        entry = np.zeros(len(member), np.int64)
        if out:
            above, links = out[-1]
            place, _ = beam(x[above], x[member[len(above) :]], links, entry[len(above) :], 1)
            entry[len(above) :] = place[:, 0]
        out.append((member, build_layer(x[member], M if layer else 2 * M, entry)))
    return out[::-1]


def beam(x: np.ndarray, q: np.ndarray, links: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` nearest found (positions, -1 for none, and distances), by best-first search from entry."""
    n_q, n = len(q), len(x)
    sq, xx = (q * q).sum(1), (x * x).sum(1)
    rows = np.arange(n_q)
    place = np.full((n_q, width), -1, np.int32)
    dist = np.full((n_q, width), np.inf)
    done = np.ones((n_q, width), bool)
    seen = np.zeros((n_q, n + 1), bool)
    place[:, 0], done[:, 0], seen[rows, entry] = entry, False, True
    dist[:, 0] = np.maximum(sq + xx[entry] - 2 * (q * x[entry]).sum(1), 0)
    live = rows
    while len(live):
        best = np.where(done[live], np.inf, dist[live]).argmin(1)
        open_ = ~done[live, best] & np.isfinite(dist[live, best])
        live, best = live[open_], best[open_]
        if not len(live):
            break
        done[live, best] = True
        near = links[place[live, best]]
        new = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(new, near, n)] = True
        d = np.maximum(sq[live, None] + xx[near] - 2 * np.einsum("qd,qkd->qk", q[live], x[near]), 0)
        d[~new] = np.inf
        all_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        all_p = np.concatenate([place[live], np.where(new, near, -1)], 1)
        all_o = np.concatenate([done[live], ~new], 1)
        dist[live], place[live], done[live] = (np.take_along_axis(a, order, 1) for a in (all_d, all_p, all_o))
    return place, dist


def search(layers: list, x: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """Rows of x nearest to each query as the graph finds them; -1 for none."""
    entry = np.zeros(len(q), np.int64)
    for level in range(len(layers) - 1, -1, -1):
        member, links = layers[level]
        place, _ = beam(x[member], q, links, entry, 1 if level else width)
        if level:
            entry = place[:, 0].astype(np.int64)  # members of a layer come first in the one below
    member = layers[0][0]
    return np.where(place >= 0, member[place], -1)


def index(vectors: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard of vectors(id, v, dim): ids, distinct vectors and, layer by layer, members and flat neighbour arrays."""

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, starts, x = distinct(pdf.id.to_numpy(np.int64), np.stack(pdf.v).astype(np.float64))
        layers = build(ids[starts[:-1]], x)
        return pd.DataFrame(
            {
                "dim": [pdf.dim.iloc[0]],
                "shard": [pdf.shard.iloc[0]],
                "shards": [pdf.shards.iloc[0]],
                "ids": [ids.tobytes()],
                "starts": [starts.astype(np.int64).tobytes()],
                "vectors": [x.tobytes()],
                "members": [[m.tobytes() for m, _ in layers]],
                "neighbours": [[a.tobytes() for _, a in layers]],
            }
        )

    schema = "dim int, shard int, shards int, ids binary, starts binary, vectors binary, members array<binary>, neighbours array<binary>"
    return sharded(vectors, rows).groupBy("dim", "shard").applyInPandas(built, schema)


def nearest(table: DataFrame, queries: DataFrame, k: int, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of table(vec_id, embedding) for each row of queries; score is the distance."""

    def one(row, q_ids, q):
        ids = np.frombuffer(row.ids, np.int64)
        starts = np.frombuffer(row.starts, np.int64)
        x = np.frombuffer(row.vectors).reshape(-1, row.dim)
        layers = [(np.frombuffer(m, np.int32), np.frombuffer(a, np.int32)) for m, a in zip(row.members, row.neighbours)]
        layers = [(m, a.reshape(len(m), -1)) for m, a in layers]
        got = search(layers, x, q, max(ef, k + 1))
        at, col = np.nonzero(got >= 0)
        found = got[at, col]
        exact = np.sqrt(((q[at] - x[found]) ** 2).sum(1))
        # Of a vector's ids the k smallest besides the query's own can be among the k nearest.
        most = k + int(np.unique(ids, return_counts=True)[1].max())
        n = np.minimum(starts[found + 1] - starts[found], most)
        hit = np.repeat(np.arange(len(found)), n)
        vec = ids[starts[found[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)]
        out = pd.DataFrame({"query_id": q_ids[at[hit]], "vec_id": vec, "score": exact[hit]})
        out = out[out.query_id != out.vec_id].sort_values(["query_id", "score", "vec_id"])
        return out.groupby("query_id").head(k)

    shards = cut_lineage(index(usable(table, True)))
    found = against_queries(shards, usable(queries, True), one, "query_id long, vec_id long, score double")
    return ranked(found, k, [F.col("score")])
