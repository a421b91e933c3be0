"""Row numbers within keys of any size.

A window over a key sorts all rows of the key in one task.  Here rows are sorted by range of key and
order, so a frequent key spans as many partitions as it fills; a partition's rows are numbered where they are,
and the rows that a key has in the partitions before are added from a table of one row a key and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def numbered_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "n", least: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """df with ``name``: 1, 2, .. within the keys (null is a key) by the order; of equal places the order is any, but fixed.

    least: {new column: column} for the smallest value of a column in a row's key, from the same pass.
    Without keys all rows are numbered.
    """
    least = least or {}
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # In a table, so that a row keeps its partition and its place.
    placed = written(spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")))
    runs = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_begin"), *[F.min(c).alias(f"_least_{k}") for k, c in least.items()])
    # As many rows a key as it has partitions.
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), "_begin", before.alias("_before"), *[F.min(f"_least_{k}").over(key).alias(k) for k in least])
    on: Column = F.col("_part") == F.col("_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    number = (F.col("_place") - F.col("_begin") + F.col("_before") + 1).alias(name)
    return placed.join(runs, on).select(*df.columns, number, *least)


def first_rows(df: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows in an order; 0 and None are no limit.  Each task sends ``limit`` rows at most."""
    return df.orderBy(*order).limit(limit) if limit else df


def listed(ids: DataFrame, rows: DataFrame, position: str, key: str = "instance_id", limit: int | None = None) -> DataFrame:
    """Rows of a list of ids, in its order and as often as it names them, ``place`` counting from 1; ids without a row are passed over.

    The list is cut to its first ``limit`` ids before the join; the place is that among the rows that are left.
    """
    asked = first_rows(ids, [position], limit).select(key, F.col(position).alias("_asked"))
    found = asked.join(rows, key)
    return numbered_rows(found, [], ["_asked"], "place").drop("_asked")
