"""What the training-data operators share: sizes, shared folders, hot groups, words."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes that separate words (all ASCII but digits and letters), and A-Z in lower case.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A word of the set-join operators, as Java and DuckDB patterns read it.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="karst-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/karst-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of a text column over all rows."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def parts_for(n_bytes: int, per: int, least: int = 1) -> int:
    """Partitions of about `per` bytes."""
    return max(least, math.ceil(n_bytes / per))


def id_mod(col: str, k: int) -> Column:
    """crc32 of the id as text, mod k; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. lower() does just that where every character is one byte."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, ASCII_UPPER, ASCII_LOWER)
    )


def with_group(df: DataFrame, keys: Sequence[str], value: str, best: str, size: str, salts: int = 16) -> DataFrame:
    """Add the largest `value` and the row count of each group of `keys`.

    A group may hold a third of all rows, so neither step gathers it: counts are summed in
    two levels, and each row is joined to the total of its own (keys, salt), of which a group
    has at most `salts`. Null keys form a group like any other; null values lose.
    """
    salt = "__salt"
    rows = df.withColumn(salt, F.pmod(F.xxhash64(F.col(value), F.lit(7)), F.lit(salts)).cast("int"))
    part = rows.groupBy(*keys, salt).agg(F.max(value).alias(best), F.count(F.lit(1)).alias(size))
    whole = part.groupBy(*keys).agg(F.max(best).alias(best), F.sum(size).alias(size))
    a, b = part.select(*keys, salt).alias("a"), whole.alias("b")
    lut = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select(
        *[F.col(f"a.{k}").alias(f"__k_{k}") for k in keys],
        F.col(f"a.{salt}").alias("__k_salt"),
        F.col(f"b.{best}"),
        F.col(f"b.{size}"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col(salt) == F.col("__k_salt")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(lut, cond).drop(salt, "__k_salt", *[f"__k_{k}" for k in keys])


def keep_rows(docs: DataFrame, kept: DataFrame, key: Column) -> DataFrame:
    """The rows of `docs` that `kept` (doc_id, key) names, with all their columns.

    `key` is the expression over `docs` whose value tells rows of one doc_id apart. A row that is
    repeated in `kept` (same doc_id, same text) stays once.
    """
    named = cut(kept.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("__n")), "kept")
    out = docs.join(named, docs["doc_id"].eqNullSafe(named["__id"]) & key.eqNullSafe(named["__key"]), "left_semi")
    repeated = not named.filter("__n > 1").isEmpty()
    return out.withColumn("__key", key).dropDuplicates(["doc_id", "__key"]).drop("__key") if repeated else out


_OWN: dict[str, dict] = {}


def own_cache(owner: str) -> dict:
    """A cache of this process. Workers outlive a stage, so a new owner empties the caches of the others."""
    if owner not in _OWN:
        _OWN.clear()
        _give_back()
        _OWN[owner] = {}
    return _OWN[owner]


def _give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold_words(text: str | None) -> list[bytes]:
    """Words of WORD_CLASS after lower-casing A-Z, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
