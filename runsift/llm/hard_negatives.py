"""Hard negatives by a two-dimensional block matrix multiply (SUMMA).

Rows of one length and label are dealt into blocks of about ROWS (labels of few rows share blocks), and
the components into chunks; a block's chunk is one row of a table.  Some blocks make a panel, some anchors a part,
and a panel and a part meet in one task: there the tiles of ANCHORS anchors and one block stay in place
while the chunks' products are added, and a finished tile is reduced to its best rows at once.  Scores never
leave their task, only blocks, anchors and best rows are shuffled:

1. an anchor and the blocks of its own label's group give the anchor's best rows of that label, its positives;
2. an anchor and all blocks give for each anchor and positive the best rows of other labels whose score lies in
   the window that the positive's score opens; tiles of one label alone are passed over.

So each pair of anchor and row is scored once but where labels share a block or a tile.  A block is sent to
each part, an anchor to each panel; parts and panels hold about PART_CELLS and PANEL_CELLS components, so what is
sent grows with anchors times rows only by that large a divisor.  Anchors are a stated part of the table, so the
work grows with anchors times rows, and no task ever holds more than a part, a panel and one tile.

Components x become floor(256 x), kept in 16 bits where all of a row's fit.  Products are made of doubles while
these hold every sum exactly, else of whole numbers, and added in 64 bits.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take
no part; vectors only meet those of their own length; rows that share the anchor's id are never its positives
or negatives; repeated rows are candidates each, and repeated anchors give repeated results; equal
scores go to the smaller vec_id; fewer positives or negatives are all returned; other columns are
ignored; an empty table gives no rows; components of 2^54 or more, and sums a long can't hold, raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import removed, written

SCALE = 256
#: Rows of a block and anchors of one; a chunk has CHUNK components, or a sixteenth of longer vectors.
ROWS, ANCHORS, CHUNK, MOST_CHUNKS = 2048, 256, 32, 16
#: An anchor's positives, negatives of each, and the window: LOW / OF to HIGH / OF of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH, OF = 5, 3, 50, 95, 100
#: No score: less than any that is allowed.
NONE = np.iinfo(np.int64).min

#: Components of the blocks of a panel and of the anchors of a part, about; panels of fewer blocks are made up to PANELS of them.
PANEL_CELLS, PART_CELLS, PANELS = 1 << 22, 1 << 20, 24

BLOCKS = "dim int, grp string, block int, wide int, own_parts int, all_parts int, chunk int, bytes int, ids binary, labels binary, cells binary"
ANCHOR_BLOCKS = "dim int, grp string, part int, chunk int, bytes int, ns binary, names binary, own binary, low binary, high binary, cells binary"


def shifted_label(vec_id: Column, label: Column) -> Column:
    """The labels of the registered query: every seventh vector bears the next of ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def prepared(table: DataFrame, label: Column, anchor: Column) -> DataFrame:
    """(n, id, label, s, v, dim, anchor) of the rows that take part; n numbers them; s has the components if they fit 16 bits, else v has them."""
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"), anchor.alias("anchor"))
    rows = rows.where("id is not null and label is not null and e is not null and size(e) > 0").where(F.coalesce(fine, F.lit(False)))
    whole = F.transform("e", lambda x: F.when(F.abs(x) < 2.0**54, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")))
    small = F.forall("e", lambda x: (x >= -127) & (x < 128))
    cells = [F.when(small, whole.cast("array<short>")).alias("s"), F.when(~small, whole).alias("v")]
    return rows.select(F.monotonically_increasing_id().alias("n"), "id", "label", *cells, F.size("e").alias("dim"), F.coalesce("anchor", F.lit(False)).alias("anchor"))


def groups_of(rows: DataFrame) -> DataFrame:
    """(dim, label, grp, shards, first, wide, last_panel, own_parts, all_parts) of each label: the group it is dealt with, that group's
    blocks among all of its length, the blocks of a panel, and the parts of the anchors of the group and of all.

    A label of ROWS rows or more is a group of its own; the others share groups of about as many rows.
    """
    counts = rows.groupBy("dim", "label").agg(F.count("*").alias("c"), F.count_if("anchor").alias("a"))
    few = counts.where(F.col("c") < ROWS).groupBy("dim").agg(F.ceil(F.sum("c") / ROWS).alias("shared"))
    large = F.col("c") >= ROWS
    grp = F.when(large, F.concat(F.lit("l"), F.col("label").cast("string"))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.col("shared")).cast("string")))
    named = counts.join(few, "dim", "left").select("dim", "label", "c", "a", grp.alias("grp"))
    sizes = named.groupBy("dim", "grp").agg(F.ceil(F.sum("c") / ROWS).cast("int").alias("shards"), F.sum("a").alias("own_a"))
    own = Window.partitionBy("dim")
    whole = lambda x: F.greatest(x, F.lit(1)).cast("int")
    blocks, most = F.sum("shards").over(own), whole(F.greatest(F.lit(ANCHORS), F.floor(F.lit(PART_CELLS) / F.col("dim"))))
    placed = sizes.withColumns({
        "first": (F.sum("shards").over(own.orderBy("grp")) - F.col("shards")).cast("int"),
        "wide": whole(F.least(F.floor(F.lit(PANEL_CELLS) / (F.col("dim").cast("long") * ROWS)), F.ceil(blocks / PANELS))),
        "own_parts": F.ceil(F.col("own_a") / most).cast("int"),
        "all_parts": F.ceil(F.sum("own_a").over(own) / most).cast("int"),
    }).withColumn("last_panel", F.floor((blocks - 1) / F.col("wide")).cast("int"))
    return named.select("dim", "label", "grp").join(placed.drop("own_a"), ["dim", "grp"])


def chunks(pdf: pd.DataFrame):
    """(chunk, bytes of a component, cells) of a block of vectors."""
    v = np.stack([s if s is not None else w for s, w in zip(pdf.s, pdf.v)])
    width = max(CHUNK, -(-v.shape[1] // MOST_CHUNKS))
    for k, at in enumerate(range(0, v.shape[1], width)):
        yield k, v.itemsize, np.ascontiguousarray(v[:, at : at + width]).tobytes()


def packed_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "n"])
    same = [pdf[c].iloc[0] for c in ("dim", "grp", "block", "wide", "own_parts", "all_parts")]
    head = (pdf.id.to_numpy(np.int64).tobytes(), pdf.label.to_numpy(np.int64).tobytes())
    rows = [(*same, k, size, *(head if k == 0 else (None, None)), cells) for k, size, cells in chunks(pdf)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def packed_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Anchors by label, with the windows of their positives; a place without a positive has a window that is empty."""
    pdf = pdf.sort_values(["label", "n"])
    bounds = np.array([[(-(-LOW * p // OF), HIGH * p // OF) for p in row] + [(1, 0)] * (POSITIVES - len(row)) for row in map(list, map(lambda r: map(int, r), pdf.scores))], np.int64)
    head = (*(pdf[c].to_numpy(np.int64).tobytes() for c in ("n", "id", "label")), bounds[:, :, 0].tobytes(), bounds[:, :, 1].tobytes())
    rows = [(pdf.dim.iloc[0], pdf.grp.iloc[0], pdf.part.iloc[0], k, size, *(head if k == 0 else (None,) * 5), cells) for k, size, cells in chunks(pdf)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANCHOR_BLOCKS.split(", ")])


def most_of(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole products of all rows of a with all rows of b."""
    most = most_of(a) * most_of(b) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and max(map(abs, exact.ravel())) >= 1 << 63:
        raise OverflowError("a score does not fit a long")
    return exact.astype(np.int64)


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k first of each row: higher scores, then smaller ids; NONE is no score."""
    k = min(k, scores.shape[1])
    bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    i, j = np.nonzero((scores >= bar[:, None]) & (scores != NONE))
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def vectors(pdf: pd.DataFrame, rows: int) -> list[np.ndarray]:
    """The chunks of a block in their order."""
    pdf = pdf.sort_values("chunk")
    return [np.frombuffer(c, np.int16 if size == 2 else np.int64).reshape(rows, -1) for c, size in zip(pdf.cells, pdf.bytes)]


def added(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """A tile of scores, chunk after chunk."""
    total, most = np.zeros((len(left[0]), len(right[0])), np.int64), 0
    for a, b in zip(left, right):
        part = product(a, b)
        most += most_of(part)
        if most >= 1 << 63:
            raise OverflowError("a score does not fit a long")
        total += part
    return total


def reduced(anchors: pd.DataFrame, rows: pd.DataFrame, best, keys: list[str], k: int, skipped) -> pd.DataFrame | None:
    """The k first rows by keys of what best() gives for each tile of a part and a panel; tiles of skipped(own labels, labels) are left out."""
    if not len(anchors) or not len(rows):
        return None
    head = anchors[anchors.chunk == 0].iloc[0]
    ns, names, own = (np.frombuffer(head[c], np.int64) for c in ("ns", "names", "own"))
    low, high = (np.frombuffer(head[c], np.int64).reshape(len(ns), POSITIVES) for c in ("low", "high"))
    left, found = vectors(anchors, len(ns)), None
    for _, block in rows.groupby("block"):
        first = block[block.chunk == 0].iloc[0]
        ids, labels = (np.frombuffer(first[c], np.int64) for c in ("ids", "labels"))
        right, new = vectors(block, len(ids)), []
        for at in range(0, len(ns), ANCHORS):
            p = slice(at, at + ANCHORS)
            if not skipped(own[p], labels):
                new.append(best(added([c[p] for c in left], right), ids, labels, ns[p], names[p], own[p], low[p], high[p]))
        if new:
            held = pd.concat(new if found is None else [found, *new])
            order = [*keys, "score", "vec_id"]
            found = held.sort_values(order, ascending=[c != "score" for c in order]).groupby(keys).head(k)
    return found


def best_of_label(scores, ids, labels, ns, names, own, low, high) -> pd.DataFrame:
    scores[(own[:, None] != labels) | (names[:, None] == ids)] = NONE
    i, j = first_of(scores, ids, POSITIVES)
    return pd.DataFrame({"n": ns[i], "anchor_id": names[i], "vec_id": ids[j], "score": scores[i, j]})


def best_of_others(scores, ids, labels, ns, names, own, low, high) -> pd.DataFrame:
    scores[(own[:, None] == labels) | (names[:, None] == ids)] = NONE
    found = []
    for k in range(POSITIVES):
        inside = np.where((scores >= low[:, k, None]) & (scores <= high[:, k, None]), scores, NONE)
        i, j = first_of(inside, ids, NEGATIVES)
        found.append(pd.DataFrame({"n": ns[i], "k": np.int32(k + 1), "vec_id": ids[j], "score": scores[i, j]}))
    return pd.concat(found)


def one_label(own: np.ndarray, labels: np.ndarray) -> bool:
    """Whether all anchors and all rows of a tile have the same label."""
    return bool((own == own[0]).all() and (labels == own[0]).all())


SAME, OTHERS = "n long, anchor_id long, vec_id long, score long", "n long, k int, vec_id long, score long"


def of_same(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    found = reduced(anchors, rows, best_of_label, ["n"], POSITIVES, lambda own, labels: False)
    return pd.DataFrame(columns=["n", "anchor_id", "vec_id", "score"], dtype="int64") if found is None else found


def of_others(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    found = reduced(anchors, rows, best_of_others, ["n", "k"], NEGATIVES, one_label)
    return pd.DataFrame(columns=["n", "k", "vec_id", "score"], dtype="int64") if found is None else found


def mine(table: DataFrame, label: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from table(vec_id, embedding, label).

    label and anchor may be expressions over the table; without them they are those of the registered query.
    """
    label = shifted_label(F.col("vec_id"), F.col("label")) if label is None else label
    anchor = F.col("vec_id") % 50 == 0 if anchor is None else anchor
    made: list[str] = []
    # Numbered once, in a table, so that a row has one number and one block whatever is run again.
    numbered = written(prepared(table, label, anchor), made)
    groups = written(groups_of(numbered), made)
    rows = numbered.join(groups, ["dim", "label"])
    block = (F.col("first") + F.pmod("n", "shards")).cast("int").alias("block")
    blocks = rows.select("dim", "grp", block, "wide", "own_parts", "all_parts", "n", "id", "label", "s", "v")
    blocks = written(blocks.groupBy("dim", "block").applyInPandas(packed_rows, BLOCKS), made).withColumn("panel", F.floor(F.col("block") / F.col("wide")).cast("int"))

    chosen = rows.where("anchor").withColumns({"first_panel": F.floor(F.col("first") / F.col("wide")).cast("int"), "own_last": F.floor((F.col("first") + F.col("shards") - 1) / F.col("wide")).cast("int")})
    chosen = written(chosen.drop("anchor", "first", "shards", "wide"), made)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def met(anchors: DataFrame, parts: str, panels: list[str], rows: DataFrame, best, schema: str) -> DataFrame:
        """best() of each part of anchors and each panel from the first to the last of ``panels``."""
        cells = ["dim", "grp", "part", "panel"]
        place = anchors.select("dim", "grp", *panels).distinct()
        held = anchors.withColumn("part", F.pmod(F.xxhash64("n"), F.col(parts)).cast("int")).groupBy("dim", "grp", "part").applyInPandas(packed_anchors, ANCHOR_BLOCKS)
        held = held.join(place, ["dim", "grp"]).withColumn("panel", F.explode(F.sequence(*panels))).drop(*panels)
        rows = rows.where(f"{parts} > 0").withColumn("part", each(parts)).drop("wide", "own_parts", "all_parts")
        return held.groupBy(*cells).cogroup(rows.groupBy(*cells)).applyInPandas(best, schema)

    without = chosen.withColumn("scores", F.array().cast("array<long>"))
    same = met(without, "own_parts", ["first_panel", "own_last"], blocks, of_same, SAME)
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    positives = written(same.withColumn("k", rank).where(F.col("k") <= POSITIVES), made)

    wanted = positives.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("scores"))
    # All groups' anchors together, so that a block is sent to few parts.
    every = chosen.join(wanted, "n").withColumns({"grp": F.lit(""), "first_panel": F.lit(0)})
    other = met(every, "all_parts", ["first_panel", "last_panel"], blocks.withColumn("grp", F.lit("")), of_others, OTHERS)
    rank = F.row_number().over(Window.partitionBy("n", "k").orderBy(F.desc("score"), "vec_id"))
    negatives = other.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select("n", "k", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positives.select("n", "k", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = written(pairs.join(negatives, ["n", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    removed(table.sparkSession, made)
    return found
