"""Keyed dedup, top-k, upsert and argmax; order is always an explicit column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def numbered(df: DataFrame, keys: list, order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def dedup_top_k(df: DataFrame, group: list[str], key: list[Column], position: str, k: int) -> DataFrame:
    """The first row of each key in a group, then the first k of the group; k <= 0 still gives one row.

    Positions that are numbers are combined as such before the shuffle, and only the rows at the k first of a
    group are read in full; other positions are combined with their rows.  The window's bound lets each task
    send k rows of a group at most, so a hot group costs little.  Keys compare as they are, so null and ''
    differ unless the caller makes them equal.
    """
    rest = [c for c in df.columns if c not in group]
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.withColumns(dict(zip(names, key)))
    if isinstance(df.schema[position].dataType, NumericType):
        places = keyed.groupBy(*group, *names).agg(F.min(position).alias("_place"))
        places = numbered(places, group, ["_place"], "_n").where(F.col("_n") <= max(k, 1))
        places = places.select(*[F.col(c).alias(f"_of_{c}") for c in (*group, *names)], "_place")
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, *names)]
        keyed = keyed.join(places, reduce(lambda a, b: a & b, same, F.col(position) == F.col("_place")), "left_semi")
    first = keyed.groupBy(*group, *names).agg(F.min_by(F.struct(*rest), position).alias("_row"))
    first = first.select(*group, *[F.col("_row")[c].alias(c) for c in rest])
    best = numbered(first, group, [position], "_n").where(F.col("_n") <= max(k, 1))
    return best.select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key, at the position of its first.

    Rows and positions are aggregated, not windowed, so a hot key is combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    best = df.groupBy(*keys).agg(F.max_by(row, F.col(position)).alias("_row"), F.min(position).alias("_first"))
    return best.select(*[F.col(c) if c in keys else F.col("_first").alias(c) if c == position else F.col(f"_row.{c}").alias(c) for c in df.columns])


def best_by(df: DataFrame, keys: list[str], value: Column, position: str) -> DataFrame:
    """The row of the largest value; of equal ones that with the smallest position."""
    rest = [c for c in df.columns if c not in keys]
    # The value is turned, not the position, which may be of any type that has an order; a null value comes last.
    order = F.struct(value.isNull().alias("none"), (-value).alias("value"), F.col(position).alias("at"))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def last_index(names: Column, name: Column) -> Column:
    """Position from 0 of a name's last occurrence in an array; null if it does not occur or is empty."""
    at = F.array_position(F.reverse(names), name)
    return F.when((F.coalesce(name, F.lit("")) != "") & (at > 0), F.size(names) - at)


def relevance(file: Column, name: Column, code: Column, files: Column, names: Column, apis: Column) -> Column:
    """Score of a test: preferred files and names, API names in its code, and completeness."""
    at_file, at_name = last_index(files, file), last_index(names, name)
    short = F.array_distinct(F.transform(apis, lambda a: F.substring_index(a, ".", -1)))
    hits = F.size(F.filter(short, lambda a: (a != "") & F.contains(code, a)))
    whole = (F.coalesce(file, F.lit("")) != "") & (F.coalesce(code, F.lit("")) != "")
    bonus = lambda top, at: F.when(at.isNotNull(), top - F.least(at, F.lit(20))).otherwise(0)
    return bonus(100, at_file) + bonus(80, at_name) + 8 * F.coalesce(hits, F.lit(0)) + F.when(whole, 2).otherwise(0)


def ranked(df: DataFrame, keys: list[str], score: str, position: str, name: str = "rank") -> DataFrame:
    return numbered(df, keys, [F.desc(score), F.asc(position)], name)


def first_ok_or_last(df: DataFrame, keys: list[str], ok: str, position: str, most: int = 3) -> DataFrame:
    """Of the first ``most`` rows of a key the first that is ok, else the last; fallback tells of an ok row that is not the first."""
    tried = numbered(df, keys, [position], "_n").where(F.col("_n") <= most)
    good = F.coalesce(F.col(ok), F.lit(False))
    choice = F.struct(good.cast("int"), F.when(good, -F.col("_n")).otherwise(F.col("_n")))
    rest = [c for c in df.columns if c not in keys]
    best = tried.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_n"), choice).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], (F.col(f"_row.{ok}") & (F.col("_row._n") > 1)).alias("fallback"))


def neighbours(df: DataFrame, keys: list[str], order: str, value: str, reach: int = 2, name: str = "around") -> DataFrame:
    """The values of up to ``reach`` rows before and after each row, without its own."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.collect_list(value).over(w.rowsBetween(-reach, -1))
    after = F.collect_list(value).over(w.rowsBetween(1, reach))
    return df.withColumn(name, F.concat(before, after))


def top_rows(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows in an order; each task sends k rows at most."""
    return df.orderBy(*order).limit(k)


def selected_attempt(explicit: Column, checkpoints: Column) -> Column:
    """The named attempt, else the first checkpoint that is marked as selected and has a round."""
    marked = F.filter(checkpoints, lambda c: F.coalesce(c["selected"], F.lit(False)) & c["round_id"].isNotNull())
    return F.coalesce(explicit, F.try_element_at(marked, F.lit(1))["round_id"])


def first_of_signature(df: DataFrame, keys: list[str], signature: Column, position: str, status: str = "status") -> DataFrame:
    """Rows whose signature occurred before in their key get the status DUPLICATE."""
    w = Window.partitionBy(*keys, "_signature").orderBy(position)
    marked = df.withColumn("_signature", signature).withColumn("_n", F.row_number().over(w))
    return marked.withColumn(status, F.when(F.col("_n") > 1, "DUPLICATE").otherwise(F.col(status))).drop("_n", "_signature")
