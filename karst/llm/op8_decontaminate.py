"""Benchmark passages in documents: a prefix-filtered set join in DataFrame operations only.

A window is WINDOW consecutive words of an item; a shorter item is one window. Containment of a
whole window needs each of its words, so the rarest one is a sufficient prefix: words are ordered
by their count in the documents, and only document words that are the rarest of some window join.
Positional bound: the window must begin at or after the text's start. Length bound: it must end
at or before the text's end. What is left is verified word by word.

The windows are broadcast in blocks of about BLOCK_WINDOWS and BLOCK_BYTES of words; a larger
benchmark takes several passes over the documents. Documents are read once per block, and their
words never leave the task that read them: only hits (position, number of the window's items) are
shuffled. No list of items travels with windows or hits: windows that the same items share have one
number, documents with the same numbers form a profile, and items are joined to distinct profiles
only, so a prompt that all items and a third of the documents share is looked up once.

Null texts have no words; empty texts and items give no hits. Items without an id count as item
''. Rows that repeat an id and a text are returned as often as they occur; an empty benchmark
leaves all documents clean; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import WORD_CLASS, ascii_lower, cut

WINDOW = 10
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 64 << 20
BROADCAST_WORDS = 1_000_000
#: No word holds this character.
END_MARK = "\x00"


def words(text: Column) -> Column:
    """Words of a text in order, A-Z in lower case."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD_CLASS})"), F.lit(1))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct pairs of a window and an item that has it: win, item (its id as text)."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")
    ).filter(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    each = items.select("item", "w", F.explode(at).alias("at")).select("item", F.slice("w", F.col("at"), size).alias("win"))
    return each.distinct()


def numbered(pairs: DataFrame) -> DataFrame:
    """Distinct windows: win, n (its words), set (the number of its items; windows with the same items share it).

    Items are told by their count and two sums of hashes, 128 bits in all; none are gathered. A number
    is the least hash of a window that has them.
    """
    wide = lambda seed: F.sum(F.xxhash64("item", F.lit(seed)).cast("decimal(20,0)"))
    each = pairs.groupBy("win").agg(F.count(F.lit(1)).alias("k"), wide(1).alias("a"), wide(2).alias("b"))
    named = each.groupBy("k", "a", "b").agg(F.min(F.xxhash64("win")).alias("set"))
    return each.join(named, ["k", "a", "b"]).select("win", F.size("win").alias("n"), "set")


def rarest(wins: DataFrame, docs: DataFrame) -> DataFrame:
    """Add each window's rarest word in the documents (ties: first in order) and its place in the window."""
    vocab = wins.select(F.explode("win").alias("word")).distinct()
    n, n_bytes = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    small = n <= BROADCAST_WORDS and n_bytes <= BLOCK_BYTES
    each = docs.select(F.explode(words(F.col("text"))).alias("word"))
    # a vocabulary too large to be broadcast meets words that are counted already, so that no frequent word is a hot key
    each = each.join(F.broadcast(vocab), "word") if small else each
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    counts = counts if small else counts.join(vocab, "word", "left_semi")
    placed = wins.select("win", F.posexplode("win").alias("offset", "word")).join(counts, "word", "left")
    best = placed.groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "offset")).alias("best"))
    return wins.join(best, "win").select("win", "n", "set", F.col("best.word").alias("word"), F.col("best.offset").alias("offset"))


def _hits(docs: DataFrame, block: DataFrame) -> DataFrame:
    """A row for each document (n = 0) and for each occurrence of a window."""
    spark = docs.sparkSession
    end = spark.range(1).select(
        F.array().cast("array<string>").alias("win"),
        F.lit(0).alias("n"),
        F.lit(None).cast("long").alias("set"),
        F.lit(END_MARK).alias("word"),
        F.lit(0).alias("offset"),
    )
    told = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    each = told.select(
        "doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit(END_MARK)))).alias("pos", "word")
    )
    start = F.col("pos") - F.col("offset")
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("win")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words")) & same
    joined = each.join(F.broadcast(block.unionByName(end)), "word").filter((F.col("n") == 0) | fits)
    return joined.select("doc_id", "text_hash", "n_words", start.alias("start"), "n", "set")


def item_lists(profiles: DataFrame, wins: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_items and items_sha256 of each profile (profile, sets): the items that have a window of the sets."""
    key = F.xxhash64("win")
    members = pairs.join(wins.filter(key == F.col("set")).select("win", "set"), "win").select("set", "item")
    named = profiles.select("profile", F.explode("sets").alias("set")).join(members, "set").select("profile", "item").distinct()
    ids = F.array_sort(F.collect_list("item"))
    listed = named.groupBy("profile").agg(ids.alias("ids"))
    return listed.select(
        "profile", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256")
    )


def run(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    pairs = cut(windows(benchmark, size), "pairs")
    wins = cut(numbered(pairs), "windows")
    n, n_bytes = wins.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("win", " "))), F.lit(0))).first()
    blocks = max(1, -(-n // block_windows), -(-n_bytes // BLOCK_BYTES))
    table = cut(rarest(wins, docs), "prefixes")
    if blocks == 1:
        parts = [_hits(docs, table)]
    else:
        part = F.pmod(F.xxhash64("win"), F.lit(blocks))
        parts = [_hits(docs, table.filter(part == i)) for i in range(blocks)]
    hits = reduce(DataFrame.unionByName, parts)
    grouped = hits.groupBy("doc_id", "text_hash", "n_words").agg(
        (F.sum(F.when(F.col("n") == 0, 1).otherwise(0)) / F.lit(blocks)).cast("int").alias("rows"),
        F.collect_set(F.when(F.col("n") > 0, F.struct("start", "n"))).alias("spans"),
        F.array_sort(F.collect_set("set")).alias("sets"),
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).alias("hit"),
            F.greatest(a["end"], x["start"] + x["n"]).alias("end"),
        ),
        lambda a: a["hit"],
    )
    profile = F.when(F.size("sets") > 0, F.sha2(F.array_join(F.col("sets").cast("array<string>"), ",").cast("binary"), 256))
    found = cut(grouped.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), "rows", "sets", profile.alias("profile")), "hits")
    lists = item_lists(found.filter("profile is not null").select("profile", "sets").dropDuplicates(["profile"]), wins, pairs)
    clean = found.filter("profile is null").select(
        "*", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256")
    )
    out = clean.unionByName(found.join(lists, "profile")).withColumn("__row", F.explode(F.sequence(F.lit(1), "rows")))
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        "n_items",
        "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop(
        "text_hash"
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN win ON dw.win = win.win AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
