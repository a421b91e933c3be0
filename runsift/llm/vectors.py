"""Vector tables in shards, and query blocks that meet every shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
KEPT = "dim int, shard int, n long, ids binary, vectors binary"


def usable(table: DataFrame, nonzero: bool) -> DataFrame:
    """(id, v, dim) of vectors that are neither null nor empty and whose components are all finite; nonzero drops zero vectors."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    got = table.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    got = got.where((F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    if nonzero:
        got = got.where(F.exists("v", lambda x: x != 0))
    return got.withColumn("dim", F.size("v"))


def sharded(vectors: DataFrame, rows: int) -> DataFrame:
    """vectors with their shard, by a hash of id, so that a shard of each dimension has about ``rows`` rows."""
    counts = vectors.groupBy("dim").agg(F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).cast("int").alias("shards"))
    return vectors.join(F.broadcast(counts), "dim").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.col("shards")).cast("int"))


def against_queries(shards: DataFrame, queries: DataFrame, search, schema: str) -> DataFrame:
    """search(shard row, query ids, query matrix) -> frame of ``schema`` for every shard and every block of queries of its dimension.

    shards has (dim, shard, shards) and what search reads; queries has (id, v, dim).  Blocks of
    QUERY_BLOCK queries are packed into one row each, and only those rows are repeated per shard.
    """

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"dim": [pdf.dim.iloc[0]], "q_ids": [pdf.id.to_numpy(np.int64).tobytes()], "q": [np.stack(pdf.v).astype(np.float64).tobytes()]})

    blocks = queries.groupBy("dim").agg(F.greatest(F.ceil(F.count("*") / QUERY_BLOCK), F.lit(1)).alias("blocks"))
    placed = queries.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("id", F.lit(6)), F.col("blocks")))
    rows = placed.groupBy("dim", "block").applyInPandas(packed, "dim int, q_ids binary, q binary")
    n = shards.select("dim", "shards").distinct()
    repeated = rows.join(F.broadcast(n), "dim").select("dim", "q_ids", "q", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def searched(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.frombuffer(row.q_ids, np.int64)
                yield search(row, ids, np.frombuffer(row.q).reshape(len(ids), row.dim))

    return repeated.join(shards.drop("shards"), ["dim", "shard"]).mapInPandas(searched, schema)


def ranked(found: DataFrame, k: int, order: list) -> DataFrame:
    """The best k rows of each query with their rank."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
