"""The corpus pipeline: documents to packed sequences, a Parquet table between every two stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexisift.llm.common import remove, shared_folder, table
from lexisift.llm.dart_minhash import near_duplicates
from lexisift.llm.packing import pack_documents
from lexisift.llm.quality_knn import fit_neighbours, held_out, score_quality
from lexisift.llm.quality_rules import judge_quality
from lexisift.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1, with all their columns.

    Null and empty texts go by the share of good labels. Texts are read whole. Repeated rows and rows with a null id
    are judged each; extra columns, of whatever name, stay as they are; an empty table gives an empty one.
    """
    model = fit_neighbours(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score_quality(docs, model, keep=True).where("predicted = 1").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned one rejects, with all their columns.

    Null and empty texts go, as the base rule wants words. Texts are read whole. Repeated rows and rows with a null
    id are judged each; extra columns, of whatever name, stay as they are; an empty table gives an empty one.
    """
    return judge_quality(docs, table(spark, sf_dir, "labels"), keep=True).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id, and those without an id.

    Null and empty texts are one class. Of rows that share the id that stays the first by text stays. Texts are read
    whole; extra columns, of whatever name, stay as they are; an empty table gives an empty one.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    first = F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text"))
    rows = docs.select(F.struct("*").alias("row"))
    chosen = rows.join(kept, F.col("row.doc_id") == F.col("kept_id"), "left_semi").withColumn("number", first).where("number = 1")
    return chosen.select("row.*").unionByName(docs.where("doc_id is null"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    A null or empty text is the end id alone. A text of any length is cut into as many pieces as it needs; repeated
    rows and rows with a null id are packed each; extra columns do not come along; an empty table gives an empty one.
    """
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2048, 1)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL has neither the votes, the learned rules, the near duplicates nor the tokens; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written in the shared folder and read again, and then what it came from goes."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
