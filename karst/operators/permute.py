"""Orders of features: round-robin bands and random shuffles; rows carry their key, so the way back is free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.operators.frequency import dense_index


def band_order(sites: DataFrame, bands: int) -> DataFrame:
    """new_pos, feature_idx: feature j goes to band j mod `bands`, bands one after the other."""
    n = sites.agg(F.count(F.lit(1)).alias("n"), F.max("feature_idx").alias("top"))
    rows = sites.select("feature_idx").crossJoin(F.broadcast(n))
    # a band's rank is that of (band, index), which are made into one number
    key = (F.col("feature_idx") % bands) * (F.col("top") + 1) + F.col("feature_idx")
    keyed = rows.select("feature_idx", key.alias("key"))
    return keyed.join(dense_index(keyed.select("key"), "key", "new_pos"), "key").select("new_pos", "feature_idx")


def perm_key(seed: int) -> Column:
    """60 bits of an MD5 digest of seed and feature: any engine makes the same order of them."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("feature_idx").cast("string"))), 1, 15), 16, 10).cast("long")


def random_order(sites: DataFrame, seed: int) -> DataFrame:
    """feature_idx and a hash to order by; equal seeds give equal orders."""
    return sites.select("feature_idx", perm_key(seed).alias("perm_key"))


def shuffled(rows: DataFrame, seed: int, parts: int) -> DataFrame:
    return rows.withColumn("perm_key", perm_key(seed)).repartitionByRange(parts, "perm_key").sortWithinPartitions("perm_key").drop("perm_key")


def restored(rows: DataFrame) -> DataFrame:
    return rows.orderBy("feature_idx")
