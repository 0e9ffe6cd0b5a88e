"""Summaries of pairwise r2 and of loadings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.operators.pca import shape
from karst.operators.prefix import running, windowed
from karst.operators.slices import few, slices
from karst.operators.tiles import gram, inner

#: Upper bounds of the distance bins, in base pairs.
BINS = (1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000)


def by_distance(pairs: DataFrame) -> DataFrame:
    """chr, distance, r2_total, n of pairs (chr_a, bp_a, bp_b, r2)."""
    rows = pairs.select(F.col("chr_a").alias("chr"), (F.col("bp_b") - F.col("bp_a")).alias("distance"), "r2")
    return rows.groupBy("chr", "distance").agg(F.sum("r2").alias("r2_total"), F.count(F.lit(1)).alias("n"))


def decay(pairs: DataFrame, window: int, bins: int, ties: Sequence[str] = ("r2", "bp_a")) -> DataFrame:
    """chr, distance (bin * window / bins), num, avg_r2, std over equally filled distance bins of each chromosome.

    The rank of a pair within its chromosome comes from sorted ranges of pairs (prefix.running), which
    the ties are part of: neither a chromosome nor a distance is ordered in one task.
    """
    rows = pairs.withColumn("chr", F.col("chr_a")).withColumn("__dist", F.col("bp_b") - F.col("bp_a"))
    whole = rows.groupBy("chr").agg(F.count(F.lit(1)).alias("__all"))
    ranked = running(rows, ["__dist", *ties], by=["chr"]).withColumnRenamed("rank", "__rank").join(whole, "chr")
    # the first (all mod bins) bins hold one pair more
    size, extra = F.floor(F.col("__all") / bins), F.col("__all") % bins
    edge = extra * (size + 1)
    bin_ = F.when(F.col("__rank") < edge, F.floor(F.col("__rank") / (size + 1))).otherwise(
        extra + F.floor((F.col("__rank") - edge) / F.greatest(size, F.lit(1)))
    )
    grouped = ranked.withColumn("bin", bin_ + 1).groupBy("chr", "bin")
    out = grouped.agg(F.count(F.lit(1)).alias("num"), F.avg("r2").alias("avg_r2"), F.stddev_samp("r2").alias("std"))
    return out.select("chr", (F.col("bin") * F.lit(float(window)) / F.lit(bins)).alias("distance"), "num", "avg_r2", "std")


def fixed_bins(pairs: DataFrame, bins: Sequence[int] = BINS) -> DataFrame:
    """bin (its upper bound), counts, r_sum, r2_sum; pairs beyond the last bound are left out. `r` is signed."""
    dist = F.col("bp_b") - F.col("bp_a")
    bin_ = F.lit(None).cast("long")
    for bound in sorted(bins, reverse=True):
        bin_ = F.when(dist <= bound, F.lit(bound).cast("long")).otherwise(bin_)
    rows = pairs.withColumn("bin", bin_).filter("bin is not null")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("counts"), F.sum("r").alias("r_sum"), F.sum(F.col("r") * F.col("r")).alias("r2_sum"))


def weighted(per_chromosome: DataFrame, n_samples: int | None = None) -> DataFrame:
    """distance, r2: means over chromosomes weighted by their pairs, bias-corrected if the samples are told."""
    out = per_chromosome.groupBy("distance").agg((F.sum(F.col("avg_r2") * F.col("num")) / F.sum("num")).alias("r2"))
    return out if n_samples is None else out.withColumn("r2", bias_corrected(F.col("r2"), n_samples))


def bias_corrected(r2: Column, n_samples: int) -> Column:
    return r2 - (1 - r2) / F.lit(float(n_samples - 2))


def cumulative_mean(rows: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The mean of a row's value and of those before it; nulls count as nothing."""
    x = F.col(value)
    told = running(rows, [order], {"__sum": x, "__n": F.when(x.isNotNull(), 1).otherwise(0)}, by)
    n = F.col("__n") + F.when(x.isNotNull(), 1).otherwise(0)
    mean = (F.col("__sum") + F.coalesce(x, F.lit(0))) / F.when(n > 0, n)
    return told.withColumn(value, mean).drop("__sum", "__n", "rank")


def running_max(rows: DataFrame, order: str, value: str, by: Sequence[str] = (), width: int = 1000) -> DataFrame:
    """The largest value of a window of `width` rows around each, as an absolute value."""
    ranked = running(rows, [order], by=by)
    made = windowed(ranked, "rank", width // 2, width - width // 2 - 1, {"__top": F.max(value)}, by)
    return made.withColumn(value, F.abs("__top")).drop("__top", "rank")


def cross_chromosome(unit: DataFrame, sites: DataFrame, first: str, second: str) -> DataFrame:
    """mean_r2 over all pairs of a site of one chromosome and one of another, from rows of length 1.

    Few sites of many samples meet in their own relation, which is a sum over slices of samples. Otherwise the
    mean needs no pair: the sum of r2 over all pairs is the inner product of the two
    chromosomes' sample-by-sample relations, which are tables of tiles.
    """
    placed = unit.join(sites.select("feature_idx", "chr"), "feature_idx").filter(F.col("chr").isin(first, second))
    a, b = placed.filter(F.col("chr") == first), placed.filter(F.col("chr") == second)
    (m1, n), (m2, _) = shape(a), shape(b)
    if not m1 or not m2:
        total = 0.0
    elif few(m1 + m2, n):
        chromosome = {r["feature_idx"]: r["chr"] for r in placed.select("feature_idx", "chr").collect()}
        features = np.array(sorted(chromosome))
        one, other = (np.array([chromosome[i] == c for i in features]) for c in (first, second))
        total = float((slices(placed, features, n).relation()[one][:, other] ** 2).mean())
    else:
        total = inner(gram(a, n), gram(b, n)) / (m1 * m2)
    return unit.sparkSession.range(1).select(F.lit(total).alias("mean_r2"))
