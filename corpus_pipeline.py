"""From raw documents to packed training sequences, in four written stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancier.llm import factors, jaccard, packing, quality
from balancier.llm.common import documents, kept, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their shingles the one of the smallest id, once.

    A document is an id and a text: rows of a null id or of one id are told apart by their texts.
    A null id counts as the smallest; of one id the text of the least hash stays. Rows equal in
    id and text are one document, of which the least row stays.
    """
    small_batches(spark)
    known = documents(docs)
    node = F.xxhash64("doc_id", "text").alias("node")
    ids = known.select("doc_id", node)
    parts = jaccard.join(spark, known.select(node.alias("doc_id"), "text"))
    parts = parts.select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")).distinct()
    first = parts.join(ids, "node").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "doc_id", "text")
    rows = documents(rows, "row").select(node, "row").join(first.select(F.col("first.node").alias("node")), "node", "left_semi")
    return rows.groupBy("node").agg(F.min("row").alias("row")).select("row.*")


def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in several places; a text may become empty."""
    small_batches(spark)
    found = factors.dedup(spark, docs, "lang", "source")
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    small_batches(spark)
    return packing.pack(spark, packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0))


STAGES = [("quality", good), ("near_duplicates", distinct), ("passages", cleaned), ("packing", packed)]

#: Learned weights and best-fit places cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = kept(spark, stage(spark, docs, sf_dir))
    return docs
