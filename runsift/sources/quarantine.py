"""Readers that part what they can't use from what they can: nothing is lost, and one bad row never ends a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import first_match
from .records import POSITION, documents, entries, field, is_array, is_object, lines, parsed

#: Why a row is set aside.
NOT_JSON, NOT_RECORDS, NOT_OBJECT, NO_ID = "not JSON", "neither a list nor an object", "not an object", "no instance_id"
BAD = f"reason string, text string, {POSITION} struct<file string, block bigint, n bigint>"
#: Fields of the record that stands for an instance that failed, and what they hold.
FAILED_TEXTS = ("selected_seed_file", "selected_seed_name", "oracle_type", "strict_verifier_decision", "strict_failure_class")
FAILED_FLAGS = ("seed_fallback_used", "oracle_rebound")


def judged(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows(key, row, text, ..) with instance_id and ``reason``, null for a row that can be used."""
    is_record = F.coalesce(is_object(F.col("row")), F.lit(False))
    own = F.when(is_record, field(F.col("row"), "instance_id"))
    missing = F.when(is_record, F.variant_get("row", "$.instance_id", "variant")).isNull()
    instance = F.when(F.col("key").isNotNull() & missing, F.col("key")).otherwise(own)
    reason = first_match(
        [
            (F.col("row").isNull(), NOT_JSON),
            (~is_record, NOT_OBJECT),
            (F.coalesce(instance, F.lit("")).isin("", "0", "false"), NO_ID),
        ],
        F.lit(None).cast("string"),
    )
    return rows.withColumns({"instance_id": instance, "reason": reason})


def judged_lines(texts: DataFrame) -> DataFrame:
    """(instance_id, row, text, reason, _pos) of every line of texts(line, _pos)."""
    rows = texts.select(F.lit(None).cast("string").alias("key"), parsed(F.col("line")).alias("row"), F.col("line").alias("text"), POSITION)
    return judged(rows).select("instance_id", "row", "text", "reason", POSITION)


def judged_documents(texts: DataFrame) -> DataFrame:
    """(instance_id, row, text, reason, _pos) of every record in the documents of texts(text, file), and a row for each document that has no records to give."""
    whole = texts.withColumn("value", parsed(F.col("text")))
    kind = first_match([(F.col("value").isNull(), NOT_JSON), (~is_array(F.col("value")) & ~is_object(F.col("value")), NOT_RECORDS)], F.lit(None).cast("string"))
    whole = whole.withColumn("kind", kind)
    place = lambda n: F.struct("file", F.lit(0).cast("long").alias("block"), n.cast("long").alias("n")).alias(POSITION)
    broken = whole.where("kind is not null").select(F.lit(None).cast("string").alias("instance_id"), F.lit(None).cast("variant").alias("row"), "text", F.col("kind").alias("reason"), place(F.lit(0)))
    listed = F.transform(F.from_json(F.when(is_array(F.col("value")), F.col("text")), "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    named = entries(F.when(is_object(F.col("value")), F.col("text")))
    items = whole.where("kind is null").select("file", F.posexplode(F.coalesce(listed, named)).alias("i", "pair"))
    items = items.select(F.col("pair.key").alias("key"), F.col("pair.value").alias("row"), F.to_json("pair.value").alias("text"), place(F.col("i")))
    return judged(items).select("instance_id", "row", "text", "reason", POSITION).union(broken)


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of judged rows: (instance_id, row, _pos), and (reason, text, _pos) with the text as it was."""
    good = rows.where("reason is null").select("instance_id", "row", POSITION)
    return good, rows.where("reason is not null").select("reason", "text", POSITION)


def load_parted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of files: .jsonl and .txt by line, others as documents of records; files that are not there give no rows."""
    if path.lower().endswith((".jsonl", ".txt")):
        return parted(judged_lines(lines(spark, path)))
    return parted(judged_documents(documents(spark, path)))


def set_aside(bad: DataFrame, path: str) -> None:
    """Adds rows to a table of those set aside, a folder for each reason."""
    bad.write.mode("append").partitionBy("reason").parquet(path)


def failed_record(instance_id: Column, error: Column, flags: dict[str, bool] | None = None) -> Column:
    """The record that stands for an instance that failed: status ERROR, the error as its reason, and nothing else known."""
    given = [F.lit(v).alias(k) for k, v in (flags or {}).items()]
    text = F.coalesce(error, F.lit(""))
    return F.struct(
        instance_id.alias("instance_id"),
        F.lit("ERROR").alias("status"),
        text.alias("error"),
        *given,
        *[F.lit("").alias(c) for c in FAILED_TEXTS],
        *[F.lit(False).alias(c) for c in FAILED_FLAGS],
        F.array().cast("array<string>").alias("mutation_ops"),
        text.alias("final_reason"),
    )
