"""The corpus pipeline: toxicity, quality, near duplicates, packing, each over all that the one before kept.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the docs of the next.  All but the last return the columns
of docs; nulls are handled as each operator's docstring says, and a row that no stage rejects stays whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.llm import jaccard_join, packing, quality, queries, toxicity

#: A document is rejected as toxic from this score on, and as poor below this probability of good quality.
TOXIC, GOOD = 0.5, 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose toxicity score is below TOXIC; the model learns from the labels of all documents.

    A null text is scored as an empty one, which has the score of no words at all; a score of just TOXIC is rejected;
    repeated rows and rows with a null doc_id are judged each by their text; an empty table gives no rows.
    """
    model = toxicity.fit(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.probability(model, F.col("text")) < TOXIC)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose probability of a grade above the lowest is at least GOOD.

    A null text is rated as an empty one; a probability of just GOOD is kept; repeated rows and rows with a null
    doc_id are judged each by their text; an empty table gives no rows.
    """
    labels = queries.table(spark, sf_dir, "labels")
    model = quality.fit(queries.table(spark, sf_dir, "documents"), quality.grades(labels), 3)
    return docs.where(quality.tail_probabilities(model, F.col("text"))[0] >= GOOD)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id, in as many rows as it has; documents without words or doc_id stay."""
    key = F.md5("text")
    classes = jaccard_join.join_rows(docs.select("doc_id", "text"), key)
    # Only the rows that go are looked up, by text too, since a doc_id may have several; ids of a class's first document are never among them.
    gone = classes.where("doc_id <> class_id").select("doc_id", "row_key").distinct()
    return docs.withColumn("row_key", key).join(gone, ["doc_id", "row_key"], "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of docs.

    A null text is an empty one, of the end token alone; a null doc_id stays null; repeated rows are packed each; of
    equally cheap cuts one is taken by a fixed rule; an empty table gives no rows.
    """
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", keep_one_of_each_group), ("packing", pack)]

#: The stages hold trained models and tokens, which SQL can't express; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows go through Parquet in the shared folder, and go when the next stage's are written."""
    from runsift.llm.graph import removed, shared_folder

    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            removed(spark, [f"{folder}/{k - 1}"] if k else [])
    return docs
