"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named and all runs in one process, as in tests, one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to and read again from the checkpoint folder, which executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """df written to and read again from the shared folder; the table's path is added to ``made``.

    For steps that follow one another: with checkpoint() the planning of each round took several times as long as that
    of the round before, presumably as it keeps the plan's estimated sizes, which joins multiply.
    """
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def least_of(pairs: DataFrame, own: bool) -> DataFrame:
    """(a, m): the least b of each a of pairs(a, b), or a itself if ``own`` and that is less.

    The sum is grouped by -a, so that its rows are dealt anew for a join by a: a join right behind the
    sum would read the sum's partitions, which Spark does not split.
    """
    low = pairs.groupBy((-F.col("a")).alias("k")).agg(F.min("b").alias("m")).select((-F.col("k")).alias("a"), "m")
    return low.select("a", F.least("a", "m").alias("m")) if own else low


def components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node it is connected with.

    Loops and repeated edges do no harm; edges with a null end are ignored; no edges give no rows.
    A hot node's edges are only ever in sums that are combined before the shuffle and in joins of two plain
    shuffles, which Spark's skew join splits.  The path of the table behind the result is added to ``made``; those of the
    rounds before are removed.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    steps: list[str] = []
    state, seen = written(pairs, steps), None
    for _ in range(MAX_ROUNDS):
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").join(least_of(both, True), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(least_of(large, False), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, steps = steps, []
        state = written(small.select("e.a", "e.b").where("a <> b").distinct(), steps)
        removed(edges.sparkSession, before)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    if made is not None:
        made += steps
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
