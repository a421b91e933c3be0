"""Bounded training samples for the classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAG_SCHEMA = "target int, idx binary, val binary"


def sample(docs: DataFrame, graded: DataFrame, rows: int) -> DataFrame:
    """(target, text) of at most ``rows`` of graded(doc_id, target): those whose doc_id hashes lowest, equal hashes by doc_id.

    The sample is bounded, so its side of the join is broadcast.
    """
    ids = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("target").alias("target"), F.min("text").alias("text"))
    return joined.select("doc_id", "target", "text")


def collect_bags(sampled: DataFrame, bags) -> tuple[np.ndarray, list]:
    """Targets and sparse rows of the sample, in order of doc_id; the rows are made on the executors.

    Columns must be below 2^16; values come in half precision, so that the driver holds four bytes an entry.
    """

    def make(batches):
        for pdf in batches:
            got = bags(pdf.text.tolist())
            yield pd.DataFrame(
                {
                    "doc_id": pdf.doc_id,
                    "target": pdf.target,
                    "idx": [i.astype(np.uint16).tobytes() for i, _ in got],
                    "val": [v.astype(np.float16).tobytes() for _, v in got],
                }
            )

    found = sampled.mapInPandas(make, "doc_id bigint, " + BAG_SCHEMA).toPandas().sort_values("doc_id", kind="stable")
    rows = [(np.frombuffer(i, np.uint16), np.frombuffer(v, np.float16)) for i, v in zip(found.idx, found.val)]
    return found.target.to_numpy(np.int64), rows
