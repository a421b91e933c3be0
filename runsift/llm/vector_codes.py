"""Vector codes of four bytes: integer codebooks for the four parts of a vector, with segment-mean lower bounds.

Components x become floor(1024 x).  Each part position has a codebook of up to ENTRIES whole vectors; ROUNDS
times every part goes to its nearest entry and every entry becomes the floored mean of its parts; then
all are assigned once more.  Spark deals out the vectors and adds up sums and counts per entry, so that
the driver sees one codebook's size, whatever the table's.

The nearest entry is found from coarse to fine.  A part is cut into 1, 2, 4, ... segments; a vector is the
sum of its segment means and a residual that is orthogonal to them, so with segments of s components

    |x - c|^2  >=  s * sum (mean_x - mean_c)^2  +  (|residual_x| - |residual_c|)^2,

which is a distance of a few coordinates.  An entry is left out once this bound, less SLACK for rounding, is
above an exact distance that is known; what survives all levels gets its exact distance in whole numbers,
ties going to the lower entry.

Defined results: vectors that are null, empty or hold null or non-finite components are left out; a null vec_id
is coded like any other, but starts no entry; rows that share a vec_id are coded each, and one of them, the
least by components, starts the entry; fewer than ENTRIES ids give shorter codebooks (none, if all ids are
null: an error); vectors of each length have codebooks of their own, and a length that four does not divide
is filled up with zeros; null labels are summed together; other columns are ignored; an empty table gives no
rows; components are exact as doubles or raise an error, as do errors that a long can't hold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts that are compared with a codebook at a time, and vectors in a stored block.
BATCH, STORED = 1024, 4096
#: Added to every bound, relative to the squared lengths: more than doubles can lose.
SLACK = 1e-9
#: From this share of pairs on, a level is measured for all pairs at once, which gives the same survivors.
DENSE = 0.1
#: Components below this have exact squared distances in 64 bits.
SMALL = 1 << 26


def features(x: np.ndarray) -> list[np.ndarray]:
    """For each level the coordinates whose squared distance is the bound: scaled segment means and the residual's length."""
    width, out, n = x.shape[1], [], 1
    x = x.astype(np.float64)
    while n < width:
        edges = np.unique(np.linspace(0, width, n + 1).astype(np.int64))
        size = np.diff(edges)
        mean = np.add.reduceat(x, edges[:-1], axis=1) / size
        rest = x - np.repeat(mean, size, axis=1)
        out.append(np.column_stack([mean * np.sqrt(size), np.sqrt((rest * rest).sum(1))]))
        n *= 2
    return out


class Codebook:
    """Entries of one part position with what their bounds need."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.small = entries, bool(np.abs(entries).max(initial=0) < SMALL)
        self.levels = [(f, (f * f).sum(1)) for f in features(entries)]

    def exact(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of x from the entries j, in whole numbers."""
        if self.small and np.abs(x).max(initial=0) < SMALL:
            gap = x - self.entries[j]
            return np.einsum("ij,ij->i", gap, gap)
        gap = x.astype(object) - self.entries[j].astype(object)
        total = (gap * gap).sum(1)
        if len(total) and max(total) >= 1 << 54:  # room for four parts and for the entry's number beside the distance
            raise OverflowError("an error does not fit a long")
        return total.astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of x."""
        parts = [self.nearest_of(x[at : at + BATCH]) for at in range(0, len(x), BATCH)]
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2

    def nearest_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, entries = np.arange(len(x)), len(self.entries)
        best = np.full(len(x), np.iinfo(np.int64).max)
        i = j = None
        for f, (g, g2) in zip(features(x), self.levels):
            f2 = (f * f).sum(1)
            if i is None or len(i) > DENSE * len(x) * entries:
                bound = f2[:, None] + g2 - 2 * f @ g.T - SLACK * (f2[:, None] + g2 + 1)
                if i is not None:
                    alive = np.full(bound.shape, np.inf)
                    alive[i, j] = bound[i, j]
                    bound = alive
                best = np.minimum(best, self.exact(x, bound.argmin(1)))
                i, j = np.nonzero(bound <= best[:, None])
            else:
                gap = f[i] - g[j]
                bound = np.einsum("ij,ij->i", gap, gap) - SLACK * (f2[i] + g2[j] + 1)
                keep = bound <= best[i]
                i, j = i[keep], j[keep]
        if i is None:  # parts of one component have no coarser level
            i, j = np.repeat(rows, entries), np.tile(np.arange(entries), len(x))
        # The entry of least distance, then number, of each row; a row's pairs lie together and none is without.
        begin = np.searchsorted(i, rows)
        distance = self.exact(x[i], j)
        least = np.minimum.reduceat(distance, begin)
        named = np.where(distance == least[i], j, entries)
        return np.minimum.reduceat(named, begin), least


def prepared(table: DataFrame) -> DataFrame:
    """(id, label, v, dim): whole components of the vectors that take part, in a length that PARTS divides."""
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where("e is not null and size(e) > 0").where(F.coalesce(fine, F.lit(False)))
    whole = F.transform("e", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")))
    filled = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size("e"), F.lit(PARTS))))
    return rows.select("id", "label", filled.alias("v"), F.size("e").alias("dim"))


def stored(rows: DataFrame) -> DataFrame:
    """(dim, ids, labels, cells): up to STORED vectors a row, as the passes read them; nulls stay in their arrays."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, -(-len(at) // STORED)):
                    held = batch.take(pa.array(part))
                    columns = [pa.array([dim], pa.int32()), *(pa.array([held.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("id", "label")), pa.array([np.asarray(held.column("v").flatten(), np.int64).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "ids", "labels", "cells"])

    return rows.mapInArrow(pack, "dim int, ids array<long>, labels array<long>, cells binary")


def first_entries(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length the vectors of the ENTRIES smallest ids, ascending; of rows that share an id the least vector."""
    # The ids alone are sorted out, with a bound that leaves ENTRIES of a length in each task; then their vectors are read.
    rank = F.row_number().over(Window.partitionBy("dim").orderBy("id"))
    ids = rows.where("id is not null").select("dim", "id").distinct().withColumn("k", rank).where(F.col("k") <= ENTRIES)
    least = rows.join(F.broadcast(ids), ["dim", "id"]).groupBy("dim", "k").agg(F.min("v").alias("v"))
    out: dict[int, list] = {}
    for r in sorted(least.collect(), key=lambda r: (r.dim, r.k)):
        out.setdefault(r.dim, []).append(r.v)
    return {dim: np.array(v, np.int64) for dim, v in out.items()}


def books_of(entries: dict[int, np.ndarray]) -> dict[int, list[Codebook]]:
    return {dim: [Codebook(p) for p in np.split(e, PARTS, axis=1)] for dim, e in entries.items()}


def block(dim: int, cells: bytes) -> np.ndarray:
    width = -(-dim // PARTS) * PARTS
    return np.frombuffer(cells, np.int64).reshape(-1, width)


def next_entries(blocks: DataFrame, entries: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The codebooks after one round: the floored means of the parts that are nearest to each entry."""

    def sums(batches):
        books, total = books_of(entries), {}
        for pdf in batches:
            for dim, cells in zip(pdf.dim.tolist(), pdf.cells):
                x = block(dim, cells)
                for p, (book, part) in enumerate(zip(books[dim], np.split(x, PARTS, axis=1))):
                    code, _ = book.nearest(np.ascontiguousarray(part))
                    s, c = total.setdefault((dim, p), (np.zeros(book.entries.shape, object), np.zeros(len(book.entries), np.int64)))
                    order = np.argsort(code, kind="stable")
                    used, begin = np.unique(code[order], return_index=True)
                    # Sums of one block fit 64 bits; over blocks they are Python's integers.
                    s[used] += np.add.reduceat(part[order], begin, axis=0).astype(object)
                    c[used] += np.diff(np.append(begin, len(order)))
        rows = [(dim, p, k, list(map(str, s[k])), int(c[k])) for (dim, p), (s, c) in total.items() for k in np.flatnonzero(c).tolist()]
        yield pd.DataFrame(rows, columns=["dim", "part", "entry", "sums", "n"])

    added = blocks.select("dim", "cells").mapInPandas(sums, "dim int, part int, entry int, sums array<string>, n long")
    cells = added.select("dim", "part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = {dim: e.copy() for dim, e in entries.items()}
    # One row for each component of each entry that is in use: the size of the codebooks.
    for r in cells.collect():
        width = out[r.dim].shape[1] // PARTS
        out[r.dim][r.entry, r.part * width + r.at] = int(r.s) // r.n
    return out


def fingerprint(entries: np.ndarray) -> str:
    numbers = ",".join(str(v) for part in np.split(entries, PARTS, axis=1) for v in part.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def codes(blocks: DataFrame, entries: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every stored vector."""
    prints = {dim: fingerprint(e) for dim, e in entries.items()}

    def assigned(batches):
        import pyarrow as pa

        books = books_of(entries)
        for batch in batches:
            for r in batch.to_pylist():
                x = block(r["dim"], r["cells"])
                found = [book.nearest(np.ascontiguousarray(part)) for book, part in zip(books[r["dim"]], np.split(x, PARTS, axis=1))]
                digits = np.column_stack([c for c, _ in found]).astype(np.uint8).tobytes().hex()
                each = [digits[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(len(x))]
                error = sum(d for _, d in found)
                columns = [pa.array(r["ids"], pa.int64()), pa.array(r["labels"], pa.int64()), pa.array(each, pa.string()), pa.array(error, pa.int64()), pa.array([prints[r["dim"]]] * len(x), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return blocks.mapInArrow(assigned, "vec_id long, label long, code string, error long, codebooks_sha256 string")


def compress(table: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of table(vec_id, embedding, label)."""
    rows = prepared(table)
    blocks = written(stored(rows))
    entries = first_entries(rows)
    for dim, there in {r.dim: True for r in blocks.select("dim").distinct().collect()}.items():
        if there and dim not in entries:
            raise ValueError(f"no vector of length {dim} has a vec_id to start a codebook from")
    for _ in range(ROUNDS):
        entries = next_entries(blocks, entries)
    coded = written(codes(blocks, entries))
    # Combined before the shuffle; a frequent label is joined by its one sum.
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same in SQL, a round a table; for vectors of one length that PARTS divides, with ids that are not null."""
    nearest = lambda t: f"""a{t} AS MATERIALIZED (
  SELECT p.r, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.e)) AS m
  FROM p JOIN b{t} b ON p.part = b.part GROUP BY p.r, p.part),"""  # noqa: E731
    renew = lambda t: f"""u{t} AS MATERIALIZED (
  SELECT part, e, list(floor(s / n)::BIGINT ORDER BY k) AS v FROM (
    SELECT a.part, a.m.e AS e, k, sum(p.v[k])::DOUBLE AS s, count(*) AS n FROM a{t} a JOIN p USING (r, part), (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM p))) AS k) GROUP BY a.part, a.m.e, k) GROUP BY part, e),
b{t + 1} AS MATERIALIZED (SELECT part, e, coalesce(u.v, b.v) AS v FROM b{t} b LEFT JOIN u{t} u USING (part, e)),"""  # noqa: E731
    return f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[1 + (part * len(v)) // {PARTS}:((part + 1) * len(v)) // {PARTS}] AS v FROM w, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM p WHERE r <= {ENTRIES}),
{"".join(nearest(t) + chr(10) + renew(t) + chr(10) for t in range(ROUNDS))}{nearest(ROUNDS)}
c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN w USING (r), h"""


SQL = _sql()
