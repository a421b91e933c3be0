"""Balanced and interleaved plans of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered_rows


def interleaved(df: DataFrame, group: str, position: str) -> DataFrame:
    """df with ``turn`` and ``first``: ordered by both, the groups take turns, each in its own order; a group may hold most of the rows."""
    return numbered_rows(df, [group], [position], "turn", {"first": position})


def grouped_by(df: DataFrame, instance: str, group: str) -> DataFrame:
    """df with ``turns_with``: its group, or its own id where the group is null or empty, so that it waits for no other."""
    return df.withColumn("turns_with", F.coalesce(F.nullif(F.col(group), F.lit("")), F.col(instance)))


def packed_groups(sizes: DataFrame, workers: int, group: str = "grp", size: str = "n", position: str = "first") -> DataFrame:
    """(group, n, worker): the largest group first, each to the worker with the least load so far, ties to the lowest.

    Only the sizes of the groups meet in one place; the rows of the groups do not.
    """
    item = F.struct((-F.col(size)).alias("minus"), F.col(position).alias("first"), F.col(group).alias("key"))
    items = sizes.groupBy().agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), workers).alias("loads"), F.array().cast("array<int>").alias("chosen"))

    def place(state, x):
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        loads = F.transform(state["loads"], lambda load, i: F.when(i == at - 1, load - x["minus"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(state["chosen"], F.array(at - 1)).alias("chosen"))

    placed = items.withColumn("chosen", F.aggregate("items", start, place, lambda s: s["chosen"]))
    return placed.select(F.explode(F.arrays_zip("items", "chosen")).alias("z")).select(F.col("z.items.key").alias(group), (-F.col("z.items.minus")).alias(size), F.col("z.chosen").alias("worker"))


def dealt(df: DataFrame, plan: DataFrame, group: str) -> DataFrame:
    """df with its worker; the plan has one row a group."""
    return df.join(plan.select(group, "worker"), group)


STEPS = ("generation", "evaluation", "export")
MODES = ("full", *STEPS)


def steps_of(mode: str, resume: bool, exists: bool, done: set[str]) -> list[str]:
    """Steps that a run mode takes; an existing run is refused unless it is resumed, and finished steps are left out."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if exists and not resume and mode in ("full", "generation"):
        raise FileExistsError("the run exists; resume it or name another")
    steps = list(STEPS) if mode == "full" else [mode]
    return [s for s in steps if s not in done or s == "export"]
