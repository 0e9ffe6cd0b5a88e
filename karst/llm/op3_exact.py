"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so: after MIN_CHARS characters, at the next sentence
end (STOPS has those of several scripts), at MAX_CHARS at the latest. A chunk is named by a 64-bit hash, and the names are verified:
the distinct contents of all chunks are brought together once, and where contents differ under
one hash, each gets an ordinal as part of its name. A document is then the ordered list of its
chunks' names (its recipe); equal recipes mean equal texts. After the one movement of distinct
chunks, only recipes travel.

Texts are equal when identical after lower-casing A-Z. Null counts as empty. Of equal texts the
row with the largest doc_id stays; a null doc_id loses against any other, and rows that repeat
both text and doc_id are all marked as kept, being one document. An empty table gives no rows.
Extra columns are ignored. A group may hold any share of the rows: it is counted in two levels
and joined through a salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.llm.common import ascii_lower, cut, with_group

MIN_CHARS, MAX_CHARS = 1024, 4096
#: Ends of lines and sentences, of Latin, Chinese, Japanese, Arabic, Urdu, Devanagari, Armenian and Ethiopic script.
STOPS = r"[.!?\n。！？｡؟۔।։።]"


def chunk_pattern(least: int = MIN_CHARS, most: int = MAX_CHARS) -> str:
    return rf"(?s).{{{least},{most - 1}}}?(?:{STOPS}|\z)|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def chunks(norm: Column) -> Column:
    """The chunks of a text in order; together they are the text."""
    return F.regexp_extract_all(norm, F.lit(chunk_pattern()), F.lit(0))


def _recipes(rows: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """doc_id, digest, length in bytes, and the hashes of the chunks, of texts in `norm`."""
    return rows.select(
        "doc_id",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("norm").alias("n_bytes"),
        F.transform(chunks(F.col("norm")), lambda c: name(c)).alias("recipe"),
    )


def _clashes(rows: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """Hashes under which there are several contents: h, content, ordinal from 0. As a rule none."""
    each = rows.select(F.explode(chunks(F.col("norm"))).alias("content"))
    contents = each.select(name(F.col("content")).alias("h"), "content").distinct()
    several = cut(contents.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "clashes").select("h")
    if several.isEmpty():
        return several.select("h", F.lit("").alias("content"), F.lit(0).alias("ordinal"))
    order = Window.partitionBy("h").orderBy("content")
    return cut(
        contents.join(several, "h", "left_semi").withColumn("ordinal", F.row_number().over(order) - 1), "clash-contents"
    )


def run(docs: DataFrame, name: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("norm"))
    clashes = _clashes(rows, name)
    recipes = cut(_recipes(rows, name), "recipes")
    ordinals = F.lit(None).cast("array<struct<pos:int,ordinal:int>>")
    if clashes.isEmpty():
        recipes = recipes.withColumn("ordinals", ordinals)
    else:
        # texts that hold such a chunk, once each; the digest only finds the row of the same text again
        placed = (
            rows.select(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.posexplode(chunks(F.col("norm"))))
            .select("text_sha256", "pos", F.col("col").alias("content"), name(F.col("col")).alias("h"))
            .join(clashes, ["h", "content"])
            .groupBy("text_sha256")
            .agg(F.array_sort(F.collect_set(F.struct("pos", "ordinal"))).alias("ordinals"))
        )
        recipes = recipes.join(placed, "text_sha256", "left")
    out = with_group(recipes, ["n_bytes", "recipe", "ordinals"], "doc_id", "keep_id", "group_size")
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
