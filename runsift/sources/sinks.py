"""Sinks on Spark's commit protocol, so a reader sees all of a result or none."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Folder


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def export_run(record: DataFrame, summary: DataFrame, root: str) -> None:
    """Four results of a run: records, their tests alone, the summary and the checkpoint index."""
    from ..operators.joins import checkpoint_index, tests_only

    write_json(record, f"{root}/all_outputs")
    write_json(tests_only(record), f"{root}/tests_only")
    write_json(summary, f"{root}/final_summary")
    write_json(checkpoint_index(record), f"{root}/checkpoint_index")


def append_shard(df: DataFrame, path: str, shard: str) -> None:
    """Replaces one shard of a partitioned result, so writing it again changes nothing."""
    df.withColumn("shard", F.lit(shard)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def run_config(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The current one-row configuration, with created_at kept from an earlier one if there is one."""
    before = previous.agg(F.min("created_at").alias("_before"))
    return current.join(before).select(*[F.coalesce("_before", "created_at").alias("created_at") if c == "created_at" else c for c in current.columns])


def log_batch(batch: DataFrame, number: int, path: str) -> None:
    """Writes one batch of a log to a folder of its number; a batch that comes again takes the place of itself."""
    batch.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/batch={number}")


def append_log(snapshots: DataFrame, path: str, checkpoint: str):
    """Adds every snapshot of a stream to a log; available files once, then it ends.

    A stream that is started again may repeat its last batch: the log then has it once.
    """
    write = snapshots.writeStream.outputMode("complete").foreachBatch(lambda batch, number: log_batch(batch, number, path))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every snapshot of a log with its ``batch``; order by it for the course of a run."""
    return spark.read.schema(f"{schema}, batch bigint").json(path)


def merged_results(spark: SparkSession, root: str, shards: str = "worker_*/results.json") -> DataFrame:
    """(instance_id, value, _pos): the shards' results, of an instance in several the one of the shard that was finished last.

    Each shard is a JSON object of results by instance; shards finished at the same time count by their path.  _pos is
    the place where the instance was first seen.
    """
    from ..operators.ranking import last_wins
    from .records import POSITION, entries

    whole = spark.read.text(f"{root}/{shards}", wholetext=True)
    finished = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
    pairs = whole.select(finished.alias("shard"), F.posexplode(entries(F.col("value"))).alias("i", "pair"))
    rows = pairs.select(F.col("pair.key").alias("instance_id"), F.col("pair.value").alias("value"), F.struct("shard", "i").alias(POSITION))
    return last_wins(rows, ["instance_id"], POSITION)


def result_metrics(merged: DataFrame) -> DataFrame:
    """One row over merged(instance_id, value): totals, rate and percent by the results' own flag of success, and a map of their statuses."""
    from ..operators.metrics import rate, status_counts
    from ..functions.text import percent

    read = merged.select(F.coalesce(F.try_variant_get("value", "$.success", "boolean"), F.lit(False)).alias("success"), F.try_variant_get("value", "$.status", "string").alias("status"))
    wins, total = F.count_if("success"), F.count("*")
    one = read.agg(total.alias("total_instances"), wins.alias("f2p_success"), (total - wins).alias("f2p_fail"), rate(wins, total).alias("f2p_at_1"), percent(wins, total).alias("f2p_at_1_percent"))
    counts = status_counts(read, "status").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    # Both sides are one row.
    return one.join(counts)


def write_merged(spark: SparkSession, root: str, shards: str = "worker_*/results.json") -> DataFrame:
    """Writes the merged results and their metrics under root and returns the metrics as written; a reader sees either whole."""
    merged = merged_results(spark, root, shards)
    merged.select("instance_id", "value").write.mode("overwrite").parquet(f"{root}/merged_results")
    kept = spark.read.parquet(f"{root}/merged_results")
    result_metrics(kept).write.mode("overwrite").parquet(f"{root}/metrics")
    return spark.read.parquet(f"{root}/metrics")


class Run:
    """A run's folder: its configuration, its manifest and the markers of its finished steps.

    A marker is written after its step's results, so a run that was interrupted goes on with the step that it was in.
    """

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], str]):
        self.folder, self.now = Folder(spark, root), now

    def begin(self, mode: str, resume: bool, config: dict) -> list[str]:
        """Writes configuration and manifest and returns the steps to take; an existing run is refused unless it is resumed."""
        from ..operators.schedule import steps_of

        steps = steps_of(mode, resume, self.folder.exists("run_config.json"), self.done())
        old = json.loads(self.folder.get("run_config.json") or "{}")
        made = {**config, "created_at": old.get("created_at") or self.now(), "updated_at": self.now()}
        self.folder.put("run_config.json", json.dumps(made, ensure_ascii=False, indent=2) + "\n")
        before = self.folder.get("manifest.txt")
        prefix, word = ("resume_", "resume_started_at") if before else ("", "started_at")
        lines = [f"{word}: {self.now()}", f"{prefix}mode: {mode}", *[f"{prefix}{k}: {v}" for k, v in config.items()]]
        self.folder.put("manifest.txt", (before + "\n" if before else "") + "\n".join(lines) + "\n")
        return steps

    def done(self) -> set[str]:
        """Steps that have a marker."""
        return {name.removesuffix(".done") for name in self.folder.names() if name.endswith(".done")}

    def take(self, step: str, work: Callable[[], None]) -> None:
        """Runs a step and marks it; the marker of a step that is taken again goes first, and those of the steps behind it with it."""
        from ..operators.schedule import STEPS

        for later in STEPS[STEPS.index(step) :]:
            self.folder.remove(f"{later}.done")
        work()
        self.folder.put(f"{step}.done", "")

    def self_check(self, summary: dict, outputs: list[str]) -> str:
        """Writes and returns a report of the run's summary and of which outputs are there."""
        shown = [f"- {k}: {json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else v}" for k, v in summary.items()]
        there = [f"- `{name}`: {self.folder.exists(name)}" for name in outputs]
        text = "\n".join(["# Run self check", "", f"- Updated at: {self.now()}", *shown, *there]) + "\n"
        self.folder.put("self_check.md", text)
        return text


def spec_json(spec: DataFrame, out: str = "spec") -> DataFrame:
    """Each row as JSON; test_cmd stays '' as readers of the format expect."""
    return spec.select("*", F.to_json(F.struct("*", F.lit("").alias("test_cmd"))).alias(out))
