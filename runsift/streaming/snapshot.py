"""Progress of a run: as a batch snapshot, and as a stream over its event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import phase
from ..functions.text import one_line, truthy

#: Statuses that are no failure.
GOOD = ("SURROGATE_F2P_SUCCESS", "ISSUE_ALIGNED_FAIL", "GENERATED")


def recent_failures(summaries: DataFrame, k: int = 10, good: tuple[str, ...] = GOOD) -> DataFrame:
    """The k latest summaries(instance_id, mtime, status, final_reason, notes, error) of a bad status; every order descends."""
    status = F.when(truthy("status") == "", "INVALID_SUMMARY").otherwise(F.col("status"))
    bad = summaries.select("mtime", "instance_id", status.alias("status"), one_line(truthy("final_reason", "notes", "error"), 240).alias("reason")).where(~F.col("status").isin(*good))
    return bad.orderBy(F.desc("mtime"), F.desc("instance_id"), F.desc("status"), F.desc("reason")).limit(k)


def counters(folders: DataFrame) -> DataFrame:
    """One row from folders(instance_id, running, has_test, has_summary, mtime); a folder may be both running and finished."""
    return folders.agg(F.count_if("running").alias("running"), F.count_if("has_test").alias("tests"), F.count_if("has_summary").alias("summaries"), F.max("mtime").alias("newest"))


def exclusive_counters(folders: DataFrame) -> DataFrame:
    """As counters, but a finished folder is not running."""
    return folders.agg(F.count_if("has_summary").alias("complete"), F.count_if(F.expr("running and not has_summary")).alias("running"))


def phases(markers: DataFrame) -> DataFrame:
    """(run_id, phase) from markers(run_id, marker)."""
    return markers.groupBy("run_id").agg(F.collect_set("marker").alias("m")).select("run_id", phase(F.col("m")).alias("phase"))


def event_stream(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """Events as a stream of the files that a folder or pattern names; ts as a timestamp, so that watermarks apply."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def status_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


def windowed_totals(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extra: counts by time window, with late events up to a bound."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a complete-mode stream over what is there, then reads its final state, written to path at every batch."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)
