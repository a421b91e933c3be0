"""Counts, rates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import status_or
from ..functions.text import percent


def status_counts(df: DataFrame, status: str, missing: str = "UNKNOWN") -> DataFrame:
    return df.groupBy(status_or(F.col(status), missing).alias("status")).agg(F.count("*").alias("n"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole; 0 for no rows."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def evaluation_metrics(evaluated: DataFrame, status: str = "status") -> DataFrame:
    """One row: totals, rate and percent over the evaluated rows alone."""
    wins = F.count_if(F.col(status) == "F2P_SUCCESS")
    total = F.count("*")
    return evaluated.agg(total.alias("total_instances"), wins.alias("f2p_success"), (total - wins).alias("f2p_fail"), rate(wins, total).alias("f2p_at_1"), percent(wins, total).alias("f2p_at_1_percent"))


def final_summary(record: DataFrame) -> DataFrame:
    """One row over all requested ids: counts, rate, and maps of status and failure category."""
    wins = F.count_if("formal_evaluation.is_f2p_success")
    one = record.agg(F.count("*").alias("total_instances"), F.count_if("generated").alias("generated_count"), F.count_if("evaluated").alias("evaluated_count"), wins.alias("f2p_success_count"), rate(wins, F.count("*")).alias("f2p_success_rate"))
    by_status = status_counts(record.select("formal_evaluation.status"), "status", "NOT_EVALUATED")
    by_category = record.where("formal_evaluation.failure_category is not null").groupBy(F.col("formal_evaluation.failure_category").alias("status")).agg(F.count("*").alias("n"))
    as_map = lambda df, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias(name))
    return one.join(as_map(by_status, "status_counts")).join(as_map(by_category, "failure_category_counts"))


def run_summary(on_disk: DataFrame, skipped: DataFrame, requested: DataFrame) -> DataFrame:
    """One row; ok and error are over the summaries on disk, skip over this run, so the parts may exceed total."""
    disk = on_disk.agg(F.count_if(~F.coalesce(F.col("status"), F.lit("")).isin("ERROR", "MISSING_SUMMARY")).alias("ok"), F.count_if(F.coalesce(F.col("status"), F.lit("")).isin("ERROR", "MISSING_SUMMARY")).alias("error"))
    return requested.agg(F.count("*").alias("total")).join(disk).join(skipped.agg(F.count("*").alias("skip")))


def rewrite_summary(results: DataFrame) -> DataFrame:
    """One row over one base of results(instance_id, status): the parts add up to no more than the total."""
    count = lambda word: F.count_if(F.col("status") == word).alias(word.lower())
    return results.agg(F.count("*").alias("total"), count("OK"), count("SKIP"), count("ERROR"))


def by_frequency(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, n, first): counts; their order is n descending, then first seen."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
