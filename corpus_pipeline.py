"""A corpus pipeline of five of the training-data operators.

Each stage takes all that its predecessor kept, as Parquet, and returns the columns of
`documents`; the last one returns the encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm import op2_toxicity, op3_exact, op5_minhash, op6_pieces, op8_decontaminate
from karst.llm.common import cut, keep_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on their labels, doesn't call toxic."""
    model = op2_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op2_toxicity.clean(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    kept = op3_exact.run(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("key"))
    return keep_rows(docs, kept, F.sha2(op3_exact.normalised(docs["text"]).cast("binary"), 256))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the largest id."""
    kept = op5_minhash.classes(docs).filter("kept").select("doc_id", F.col("text_hash").alias("key"))
    return keep_rows(docs, kept, F.xxhash64(docs["text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    marked = op8_decontaminate.run(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    kept = marked.filter(~F.col("contaminated")).select("doc_id", F.col("text_hash").alias("key"))
    return keep_rows(docs, kept, F.xxhash64(docs["text"]))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return op6_pieces.encode_column(rows, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode),
]

#: The toxicity model isn't a query: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
