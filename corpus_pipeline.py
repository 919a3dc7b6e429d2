"""A corpus pipeline over documents: quality, near-duplicates, secrets, packing. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm.common import Workspace
from attesta.llm.kneser_ney import held_out
from attesta.llm.packing import pack_documents
from attesta.llm.quality import keep_good, train
from attesta.llm.secrets import redact
from attesta.llm.simhash import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from labels of documents whose crc32 mod 5 is not 0 and scores every text."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 0))
    return keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what the secret scan finds in their texts is masked, and n_chars follows."""
    return redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32, sequence_id, offset."""
    return pack_documents(docs, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: No stage but the secret patterns can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
