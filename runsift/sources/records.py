"""Tolerant loading of JSON, JSONL and ID-list files into DataFrames with an order column _pos.

A record is kept as VARIANT under ``row``; typed columns are taken from it by name, so unknown or
oddly typed fields never break a scan.  One JSON document is one row until it is exploded, so files are
read whole only where the format forces it; JSONL and ID lists are split by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder  # noqa: F401

#: Column of a record's place; its parts are compared from left to right.
POSITION, PLACE = "_pos", "struct<file string, block bigint, n bigint>"


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def is_array(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def entries(text: Column) -> Column:
    """array<struct<key, value variant>> of an object, keys in the order of the text; null otherwise."""
    return F.map_entries(F.from_json(text, "map<string,variant>"))


def field(row: Column, name: str, kind: str = "string") -> Column:
    """A field of a VARIANT record, null if it is missing or of another type."""
    return F.try_variant_get(row, f"$.{name}", kind)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, _pos): stripped lines that are not blank; _pos orders by file name and by place in the file, however Spark deals out its parts."""
    place = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("n"))
    raw = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"), place.alias(POSITION))
    return raw.where("line <> ''")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(text, file): whole files; a path that matches nothing gives no rows."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("file"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "text string, file string")




def exploded(whole: DataFrame, text: str = "text") -> DataFrame:
    """(key, row, _pos) of documents that hold a list (key null) or an object of records (key its name)."""
    items = F.from_json(F.when(F.regexp_like(F.col(text), F.lit(r"^\s*\[")), F.col(text)), "array<variant>")
    named = entries(F.when(F.regexp_like(F.col(text), F.lit(r"^\s*\{")), F.col(text)))
    as_pairs = F.coalesce(F.transform(items, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))), named)
    placed = F.struct("file", F.lit(0).cast("long").alias("block"), F.col("i").cast("long").alias("n")).alias(POSITION)
    return whole.select("file", F.posexplode(as_pairs).alias("i", "pair")).select(F.col("pair.key").alias("key"), F.col("pair.value").alias("row"), placed)


def _strict(df: DataFrame) -> DataFrame:
    return df.withColumn("row", F.when(F.col("row").isNotNull(), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.col("line")).cast("string"))))


def load_any(spark: SparkSession, path: str) -> DataFrame:
    """(key, row, _pos) of a .jsonl file, of which every line must be JSON, or of a JSON document."""
    if path.endswith(".jsonl"):
        rows = lines(spark, path).withColumn("row", parsed(F.col("line")))
        return _strict(rows).select(F.lit(None).cast("string").alias("key"), "row", POSITION)
    return exploded(documents(spark, path))


def identified(rows: DataFrame) -> DataFrame:
    """(instance_id, row, _pos): objects with an id; the key stands in for a missing one; null, '' and 0 are no ids."""
    own = field(F.col("row"), "instance_id")
    given = F.when(F.col("key").isNotNull() & F.variant_get("row", "$.instance_id", "variant").isNull(), F.col("key")).otherwise(own)
    return rows.where(is_object(F.col("row"))).select(given.alias("instance_id"), "row", POSITION).where("coalesce(instance_id, '') not in ('', '0', 'false')")


def load_issues(spark: SparkSession, path: str) -> DataFrame:
    """One row an id: the last record of it, at the place of the first."""
    from ..operators.ranking import last_wins

    return last_wins(identified(load_any(spark, path)), ["instance_id"], POSITION)


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, row, _pos), never failing: a line that is not JSON becomes an id, other than objects are dropped; no file, no rows."""
    if path.lower().endswith((".jsonl", ".txt")):
        try:
            raw = lines(spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], f"instance_id string, row variant, {POSITION} {PLACE}")
        as_id = F.parse_json(F.to_json(F.struct(F.col("line").alias("instance_id"))))
        rows = raw.select(F.coalesce(parsed(F.col("line")), as_id).alias("row"), POSITION).where(is_object(F.col("row")))
        return rows.select(field(F.col("row"), "instance_id").alias("instance_id"), "row", POSITION)
    rows = exploded(documents(spark, path)).where(is_object(F.col("row")))
    return rows.select(F.coalesce(field(F.col("row"), "instance_id"), F.col("key")).alias("instance_id"), "row", POSITION)


def load_hits(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, row, name, _pos) of retrieval hits in any of three shapes: {id: [..]}, {id: {name: {..}}}, [{instance_id, ..}].

    In the second shape the inner key overrides the record's name; items that are no objects are dropped.
    """
    rows = load_any(spark, path).withColumn("text", F.to_json("row"))
    items = F.from_json(F.when(is_array(F.col("row")), F.col("text")), "array<variant>")
    listed = F.transform(items, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    flat = rows.where("key is null").select(field(F.col("row"), "instance_id").alias("instance_id"), "row", F.lit(None).cast("string").alias("name"), F.struct(F.col(POSITION).alias("at"), F.lit(0).alias("item")).alias("o"))
    nested = rows.where("key is not null").select("key", POSITION, F.posexplode(F.coalesce(listed, entries(F.when(is_object(F.col("row")), F.col("text"))))).alias("i", "pair"))
    nested = nested.select(F.col("key").alias("instance_id"), F.col("pair.value").alias("row"), F.col("pair.key").alias("name"), F.struct(F.col(POSITION).alias("at"), F.col("i").alias("item")).alias("o"))
    both = flat.union(nested).where(is_object(F.col("row")))
    return both.select("instance_id", "row", F.coalesce("name", field(F.col("row"), "name")).alias("name"), F.col("o").alias(POSITION))


#: JSON forms that count as no value.
NOTHING = ("null", '""', "0", "0.0", "false", "[]", "{}")


def first_field(row: Column, *names: str) -> Column:
    """The first of the named fields that holds a value, as text; '' if none does."""
    value = lambda name: F.when(~F.to_json(F.try_variant_get(row, f"$.{name}", "variant")).isin(*NOTHING), field(row, name))
    return F.coalesce(*map(value, names), F.lit(""))


def raw_code_key(row: Column) -> Column:
    """The key of a code hit as it stands, as JSON texts: path, name, first and last line; a missing field is '', but null and 5 and "5" differ."""
    value = lambda name: F.to_json(F.try_variant_get(row, f"$.{name}", "variant"))
    text = lambda c: F.coalesce(c, F.lit('""'))
    named = F.when(~value("obj_name").isin(*NOTHING), value("obj_name")).otherwise(text(value("name")))
    return F.array(text(value("path")), named, text(value("code_start_line")), text(value("code_end_line")))


def code_hits(hits: DataFrame) -> DataFrame:
    """hits(instance_id, row, _pos) of source code with typed columns, each under any of its names, and the raw ``key`` that tells hits apart."""
    row = F.col("row")
    return hits.select(
        "instance_id",
        POSITION,
        first_field(row, "path").alias("path"),
        first_field(row, "obj_name", "name").alias("name"),
        first_field(row, "node_type").alias("node_type"),
        first_field(row, "parent").alias("parent"),
        F.coalesce(field(row, "code_start_line"), F.lit("")).alias("start"),
        F.coalesce(field(row, "code_end_line"), F.lit("")).alias("end"),
        first_field(row, "code_content", "content", "code").alias("content"),
        raw_code_key(row).alias("key"),
    )


def test_hits(hits: DataFrame) -> DataFrame:
    """hits(instance_id, row, _pos) of tests with typed columns, each under any of its names."""
    row = F.col("row")
    return hits.select(
        "instance_id",
        POSITION,
        first_field(row, "file", "path").alias("file"),
        first_field(row, "name", "test_name").alias("name"),
        first_field(row, "code_content", "content", "code").alias("content"),
    )


def document_or(spark: SparkSession, path: str, default: str = "{}") -> DataFrame:
    """(file, value) of JSON documents; one that does not parse gets the default."""
    return documents(spark, path).select("file", F.coalesce(parsed(F.col("text")), F.parse_json(F.lit(default))).alias("value"))


def instance_of(file: Column) -> Column:
    """The name of the folder a file is in."""
    return F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)


def summaries(spark: SparkSession, root: str, with_formal: bool = False) -> DataFrame:
    """(instance_id, value) of root/*/summary.json; the folder formal_eval is left out unless asked for."""
    found = document_or(spark, f"{root}/*/summary.json").select(instance_of(F.col("file")).alias("instance_id"), "value")
    return found if with_formal else found.where("instance_id <> 'formal_eval'")


def summary_with_fallback(ids: DataFrame, on_disk: DataFrame, in_memory: DataFrame) -> DataFrame:
    """(instance_id, status): from disk, else from memory, else MISSING_SUMMARY."""
    disk = on_disk.select("instance_id", F.col("status").alias("_disk"))
    memory = in_memory.select("instance_id", F.col("status").alias("_memory"))
    return ids.join(disk, "instance_id", "left").join(memory, "instance_id", "left").select("instance_id", F.coalesce("_disk", "_memory", F.lit("MISSING_SUMMARY")).alias("status"))


def shard_results(spark: SparkSession, root: str) -> DataFrame:
    """(instance_id, value): merged_results.json if it is an object, else the union of worker_*/results.json, the last path winning."""
    from ..operators.ranking import last_wins

    merged = documents(spark, f"{root}/merged_results.json").where(is_object(parsed(F.col("text"))))
    if merged.isEmpty():
        merged = documents(spark, f"{root}/worker_*/results.json")
    pairs = merged.select("file", F.posexplode(entries(F.col("text"))).alias("i", "pair"))
    rows = pairs.select(F.col("pair.key").alias("instance_id"), F.col("pair.value").alias("value"), F.struct("file", "i").alias(POSITION))
    return last_wins(rows, ["instance_id"], POSITION).drop(POSITION)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("line").alias("instance_id"), POSITION)


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the file changed last; of equal times the last by name."""
    return spark.read.format("binaryFile").load(path).groupBy().agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).where("path is not null")


TRANSCRIPT = "array<struct<role string, content string, tool_call_id string, tool_calls array<struct<id string, type string, function struct<name string, arguments string>>>>>"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(id, _pos, role, content, tool_call_id, tool_calls) of chat transcripts, a file each."""
    whole = documents(spark, path).select(F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("id"), F.from_json("text", TRANSCRIPT).alias("messages"))
    return whole.select("id", F.posexplode("messages").alias(POSITION, "m")).select("id", POSITION, "m.*")


def requirement_lines(text: Column, extra: Column) -> Column:
    """Lines of a requirements file: those of the file it refers to first; editable, comment and own-test lines dropped."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~F.startswith(x, F.lit("-r")))
    more = F.split(F.coalesce(extra, F.lit("")), "\n")
    refers = F.exists(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.startswith(x, F.lit("-r")))
    every = F.when(refers, F.concat(more, own)).otherwise(own)
    return F.filter(every, lambda x: (F.trim(x) != "") & ~F.regexp_like(F.trim(x), F.lit(r"^(-e \.|#|\.\[test)")))
