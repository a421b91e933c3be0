"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed word n-grams.  Equal sets become one node with a multiplicity.
MinHash bands bring nodes that share a band into a bucket; of buckets with the same nodes that of the
lowest band stays.  Buckets that share nodes make a component (found along stars around each bucket's
smallest node, so a bucket of m nodes costs m edges).  A component is compared in one of two ways,
whichever has fewer pairs: all of its nodes with each other, or the nodes of each of its buckets with each
other, in which case a pair counts in the bucket of the lowest band that both share.  So a component costs
no more than its buckets do and no more than the square of its nodes.

What is compared is cut by a hash into parts of about BLOCK nodes and CELLS n-grams; a tile is one part, or
two parts of one component or bucket.  Within a tile, pairs compare MinHash values STEP at a time; a pair is
dropped once the posterior probability that its similarity reaches the threshold (uniform prior,
so a Beta distribution) is below TOLERANCE, and every pair that is left is verified exactly.

Result: one row per document: class_id, the smallest doc_id of those it is linked with
through a chain of pairs at or above the threshold, and n_links, the number of other
documents that are at or above it (equal texts included).  Pairs are counted within tiles and
never leave them.  Steps go through tables in the shared folder, which are removed at the end.

Words are lower-cased and split at white space; a text of 1 to n - 1 words is one n-gram.
Defined results: a text that is null or has no words has no links and is its own class; rows
with a null doc_id have a null class and no links, and take no part; rows that share a doc_id
are counted one by one and are linked each by its own text; a text of any length is one set, so a tile holds
a long text's n-grams beside few others; a similarity of just the threshold is a link; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, removed, written
from .wordbag import STEP as MULTIPLIER
from .wordbag import in_slices, mixed

WORDS, THRESHOLD = 5, (4, 5)
BANDS, ROWS = 32, 6
STEP, TOLERANCE = 16, 1e-6
#: Nodes, and n-grams of all of them, of about one part.
BLOCK, CELLS = 128, 1 << 20
WORD_LIMIT = 400_000
#: A node in a tile.
TILE = "key long, band int, lo long, hi long, side long, whole boolean, node long, times long, first long, set_key binary"
#: From so many pairs on, a tile verifies by a matrix product instead of pair by pair.
MANY_PAIRS = 400

_rng = np.random.default_rng(20)
MUL_LOW, MUL_HIGH = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= WORD_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = text.lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = out * MULTIPLIER + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(32)
    return np.unique(mixed(out))


def minhash(grams: np.ndarray) -> np.ndarray:
    """BANDS x ROWS MinHash values of a non-empty set."""
    low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(grams), 512):
        h = low[at : at + 512, None] * MUL_LOW
        h += high[at : at + 512, None] * MUL_HIGH
        h ^= h >> np.uint32(15)
        least = np.minimum(least, h.min(0))
    return least


def band_keys(values: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(values[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


@lru_cache(None)
def least_matches(threshold: tuple[int, int], step: int, hashes: int, tolerance: float) -> list[int]:
    """For step, 2 step, ... compared values: the fewest matches that keep a pair.

    With m of h values equal and a uniform prior the similarity is Beta(m + 1, h - m + 1); its
    upper tail at t is the probability of at most m successes in h + 1 draws of chance t.
    """
    t, out = threshold[0] / threshold[1], []
    for h in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(h + 1, m) * t**m * (1 - t) ** (h + 1 - m)
        out.append(m)
    return out


def candidates(left: np.ndarray, right: np.ndarray, same: bool, threshold=THRESHOLD, step=STEP, tolerance=TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two MinHash matrices whose posterior never fell below the tolerance; i < j where both are the same block."""
    equal = np.zeros((len(left), len(right)), np.int16)
    for k in range(step):
        equal += left[:, k, None] == right[None, :, k]
    needed = least_matches(threshold, step, left.shape[1], tolerance)
    keep = equal >= needed[0]
    i, j = np.nonzero(np.triu(keep, 1) if same else keep)
    matches = equal[i, j].astype(np.int32)
    for s, need in enumerate(needed[1:], 1):
        if not len(i):
            break
        cols = slice(s * step, (s + 1) * step)
        for part in range(0, len(i), 65_536):
            p = slice(part, part + 65_536)
            matches[p] += (left[i[p], cols] == right[j[p], cols]).sum(1)
        keep = matches >= need
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def verified(sets_left: list, sets_right: list, i: np.ndarray, j: np.ndarray, threshold=THRESHOLD) -> np.ndarray:
    """Which of the pairs have an exact Jaccard similarity of the threshold or more."""
    if len(i) < MANY_PAIRS:
        shared = np.array([len(np.intersect1d(sets_left[a], sets_right[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:
        size = [len(s) for s in sets_left + sets_right]
        _, column = np.unique(np.concatenate(sets_left + sets_right), return_inverse=True)
        row, width, total = np.repeat(np.arange(len(size)), size), 16_384, np.zeros((len(sets_left), len(sets_right)))
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for low in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [low, low + width])
            held = np.zeros((len(size), width), np.float32)
            held[row[a:b], column[a:b] - low] = 1
            total += held[: len(sets_left)] @ held[len(sets_left) :].T
        shared = total[i, j].astype(np.int64)
    union = np.array([len(sets_left[a]) for a in i], np.int64) + np.array([len(sets_right[b]) for b in j], np.int64) - shared
    return shared * threshold[1] >= union * threshold[0]


def first_bands(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For pairs of rows of MinHash values the lowest band that they share, BANDS if there is none."""
    same = (left == right).reshape(len(left), BANDS, ROWS).all(2)
    return np.where(same.any(1), same.argmax(1), BANDS)


def pairs_of(tile: list) -> tuple[list, list, np.ndarray, np.ndarray]:
    """(left, right, i, j): the two sides of a tile and the pairs of them that are to be verified.

    tile: rows of (node, side, band, lo, hi, signature), one a node; pairs of a bucket only count if its band is the lowest they share.
    """
    head, none = tile[0], np.zeros(0, np.int64)
    left = [r for r in tile if r.side == head.lo]
    right = left if head.lo == head.hi else [r for r in tile if r.side == head.hi]
    if not left or not right or len(tile) < 2:
        return left, right, none, none
    signs = [np.stack([np.frombuffer(r.signature, np.uint32) for r in side]) for side in (left, right)]
    i, j = candidates(*signs, head.lo == head.hi)
    if head.band >= 0 and len(i):
        owned = first_bands(signs[0][i], signs[1][j]) == head.band
        i, j = i[owned], j[owned]
    return left, right, i, j


def tile_links(tile: list) -> tuple | None:
    """(a, b, links): for each linked node the smallest node it is linked with in this tile and its links, counted with multiplicity; None without links.

    tile: as for pairs_of, with times and grams.
    """
    left, right, i, j = pairs_of(tile)
    if not len(i):
        return None
    good = verified(*([np.frombuffer(r.grams, np.uint64) for r in side] for side in (left, right)), i, j)
    i, j = i[good], j[good]
    if not len(i):
        return None
    node_l, node_r, times_l, times_r = (np.array([getattr(r, c) for r in side], np.int64) for c in ("node", "times") for side in (left, right))
    nodes = np.unique(np.concatenate([node_l[i], node_r[j]]))
    links = np.zeros(len(nodes), np.int64)
    at_l, at_r = np.searchsorted(nodes, node_l[i]), np.searchsorted(nodes, node_r[j])
    np.add.at(links, at_l, times_r[j])
    np.add.at(links, at_r, times_l[i])
    root = np.arange(len(nodes))
    while True:  # labels sink to the smallest of each connected part
        before = root.copy()
        low = np.minimum(root[at_l], root[at_r])
        np.minimum.at(root, at_l, low)
        np.minimum.at(root, at_r, low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root], links


def tiles_of(batches):
    """Rows sorted by tile and node as lists, a tile each; rows of a node that are equal count once."""
    tile, current = [], None
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if (r.key, r.band, r.lo, r.hi) != current:
                if tile:
                    yield tile
                tile, current = [], (r.key, r.band, r.lo, r.hi)
            if not tile or tile[-1].node != r.node:
                tile.append(r)
    if tile:
        yield tile


def in_frames(rows, columns: list[str], kinds: dict):
    """Lists of rows as frames of some thousand rows."""
    held = []
    for some in rows:
        held += some
        if len(held) >= 10_000:
            yield pd.DataFrame(held, columns=columns).astype(kinds)
            held = []
    yield pd.DataFrame(held, columns=columns).astype(kinds)


def tiles_links(batches):
    """(a, b, links, whole) of the linked nodes of each tile."""

    def found():
        for tile in tiles_of(batches):
            links = tile_links(tile)
            if links is not None:
                yield [(*row, tile[0].whole) for row in zip(*(c.tolist() for c in links))]

    yield from in_frames(found(), ["a", "b", "links", "whole"], {"a": "int64", "b": "int64", "links": "int64", "whole": bool})


def tiles_used(batches):
    """The rows of each tile, signatures left out, whose nodes are in a pair that is to be verified."""
    columns = [c.split()[0] for c in TILE.split(", ")]

    def found():
        for tile in tiles_of(batches):
            left, right, i, j = pairs_of(tile)
            used = {left[k].node for k in i} | {right[k].node for k in j}
            yield [tuple(getattr(r, c) for c in columns) for r in tile if r.node in used]

    yield from in_frames(found(), columns, {"key": "int64", "band": "int32", "lo": "int64", "hi": "int64", "side": "int64", "whole": bool, "node": "int64", "times": "int64", "first": "int64"})


def described(docs: DataFrame, row_key: Column) -> DataFrame:
    """(doc_id, row_key, set_key, bands, cells): 128-bit key of a document's n-gram set, its band keys and size; documents without words have nulls."""

    def describe(batches):
        for batch in batches:
            keys, bands, cells = [], [], []
            for _, part in in_slices(batch.column("text").to_pylist()):
                for text in part:
                    grams = shingles(text)
                    keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                    bands.append(band_keys(minhash(grams)) if len(grams) else None)
                    cells.append(len(grams))
            # Ids stay in Arrow: pandas would round them beside a null.
            columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(cells, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "set_key", "bands", "cells"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key.cast("string").alias("row_key"), "text")
    return rows.mapInArrow(describe, "doc_id long, row_key string, set_key binary, bands array<long>, cells long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, measured_key, signature, grams) of documents with words, whose doc_id is not null; within a partition once for equal rows."""

    def measure(batches):
        known = set()
        for pdf in batches:
            for start, part in in_slices(pdf.text.tolist()):
                grams = [shingles(t) for t in part]
                ids = pdf.doc_id.iloc[start : start + len(part)].tolist()
                rows = []
                for i, g in zip(ids, grams):
                    key = xxhash.xxh3_128_digest(g.tobytes())
                    if len(g) and (i, key) not in known:
                        known.add((i, key))
                        rows.append((i, key, minhash(g).tobytes(), g.tobytes()))
                yield pd.DataFrame(rows, columns=["doc_id", "measured_key", "signature", "grams"])

    return docs.mapInPandas(measure, "doc_id long, measured_key binary, signature binary, grams binary")


def shared_buckets(nodes: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(bucket, band, low, m, cells) of buckets of more nodes than one, once for each set of nodes; and (bucket, node, low) of their nodes."""
    buckets = nodes.select("node", "cells", F.posexplode("bands").alias("band", "bucket"))
    # Two hashes of the whole set of nodes tell equal buckets.
    whole = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    sets = buckets.groupBy("bucket").agg(F.min("band").alias("band"), F.count("*").alias("m"), F.min("node").alias("low"), F.sum("cells").alias("cells"), *whole)
    first = sets.where("m > 1").groupBy("m", "low", "x1", "x2").agg(F.min(F.struct("band", "bucket", "cells")).alias("f"))
    kept = written(first.select("f.bucket", "f.band", "low", "m", "f.cells"), made)
    return kept, written(buckets.select("bucket", "node").join(kept.select("bucket", "low"), "bucket"), made)


def parts(n: Column, cells: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(cells / CELLS))


def in_tiles(members: DataFrame) -> DataFrame:
    """members(key, band, node, n_parts, ..) by tile: a node's part is the hash of its number, and it stands in the tiles of its part with each part."""
    side = F.pmod(F.xxhash64("node", "key"), F.col("n_parts"))
    each = members.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    return each.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("other", "n_parts")


def planned(nodes: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes of each tile (TILE): of components that are compared as a whole, and of those compared by bucket.

    whole: the tile holds all of a component.
    """
    kept, held = shared_buckets(nodes, made)
    roots = components(held.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")), made)
    grouped = roots.join(nodes.select("node", "first", "set_key", "times", "cells"), "node")
    # Sums are by -root, so that the joins by root behind them deal all rows anew and a frequent root is split.
    turned = (-F.col("root")).alias("turned")
    size = grouped.groupBy(turned).agg(F.count("*").alias("n"), F.sum("cells").alias("all_cells"))
    pairs = kept.join(roots.select(F.col("node").alias("low"), "root"), "low").groupBy(turned).agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
    together = (F.col("n") <= BLOCK) | (F.col("n").cast("double") * F.col("n") <= F.col("pairs"))
    plan = size.join(pairs, "turned").select((-F.col("turned")).alias("root"), together.alias("together"), parts(F.col("n"), F.col("all_cells")).alias("n_parts"))
    grouped = written(grouped.drop("cells").join(plan, "root"), made)

    columns = [c.split()[0] for c in TILE.split(", ")]
    by_root = grouped.where("together").withColumns({"key": F.col("root"), "band": F.lit(-1), "whole": F.col("n_parts") == 1})
    apart = grouped.where("not together").drop("n_parts")
    by_bucket = held.drop("low").join(apart, "node").join(kept.select("bucket", "band", parts(F.col("m"), F.col("cells")).alias("n_parts")), "bucket")
    by_bucket = by_bucket.withColumns({"key": F.col("bucket"), "whole": F.lit(False)})
    return in_tiles(by_root).select(columns), in_tiles(by_bucket).select(columns)


def with_texts(tiles: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """tiles with columns of measured(), rows in the order of tiles and nodes; each text is measured once."""
    firsts = tiles.select(F.col("first").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(firsts, "doc_id")
    members = tiles.join(measured(texts).select("doc_id", "measured_key", *columns), (F.col("first") == F.col("doc_id")) & (F.col("set_key") == F.col("measured_key")))
    tile = ["key", "band", "lo", "hi"]
    return members.drop("doc_id", "measured_key").repartition(*tile).sortWithinPartitions(*tile, "node")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of docs(doc_id, text)."""
    return join_rows(docs, F.lit(None)).drop("row_key")


def join_rows(docs: DataFrame, row_key: Column) -> DataFrame:
    """(doc_id, row_key, class_id, n_links) for every row of docs(doc_id, text); row_key tells rows of one doc_id apart."""
    made: list[str] = []
    seen = written(described(docs, row_key), made)
    usable = seen.where("doc_id is not null and set_key is not null")
    nodes = usable.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"), F.first("bands").alias("bands"), F.first("cells").alias("cells"))
    # Different sets may have the same smallest doc_id, so nodes have numbers of their own, fixed by the written table.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), made)
    by_root, by_bucket = planned(nodes, made)
    # Of a bucket only the nodes with a pair to verify are sent with their n-grams: a node is in many buckets, but its pairs count in one each.
    used = with_texts(written(by_bucket, made), docs, ["signature"]).mapInPandas(tiles_used, TILE)
    tiles = written(by_root.union(used), made)
    linked = written(with_texts(tiles, docs, ["signature", "grams"]).mapInPandas(tiles_links, "a long, b long, links long, whole boolean"), made)

    split = components(linked.where("not whole").select("a", "b"), made)
    roots = linked.where("whole and a <> b").select(F.col("a").alias("node"), F.col("b").alias("root")).union(split)
    counts = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = roots.union(roots.select("root", "root")).distinct()
    least = roots.join(nodes.select("node", "first"), "node").groupBy((-F.col("root")).alias("turned")).agg(F.min("first").alias("least")).select((-F.col("turned")).alias("root"), "least")
    classes = roots.join(least, "root").select("node", "least")
    known = nodes.join(counts, "node", "left").join(classes, "node", "left").select(
        "set_key", F.coalesce("least", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")
    )
    result = written(
        seen.join(known, "set_key", "left").select(
            "doc_id",
            "row_key",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        )
    )
    removed(docs.sparkSession, made)
    return result
