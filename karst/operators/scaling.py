"""Normalisation of count matrices: cells (feature_idx, sample_idx, x); absent cells are zeros.

`features` and `samples` name the rows and columns of the matrix, for those whose counts are all zero
have no cell; without `features`, those with a cell are meant.

Methods: 0 none, 1 standardise, 2 log10 with the median library size, 3 log1p, 4 relative; 2 to 4
are standardised afterwards. The matrix stays sparse until it is standardised: each method maps 0
to 0, so means and deviations need only the stored cells and the number of samples. Standardised
cells of absent counts follow from (0 - mean) / sd and are made only when `dense` is asked for.

Decompositions don't ask for them: rows of arrays are scaled where they are (`scaled_rows`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators.matrix import map_arrays, reduce_arrays

SD_TOL = 1e-10


def library_sizes(cells: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """sample_idx, libsize: integer sums over features."""
    sums = cells.groupBy("sample_idx").agg(F.sum(F.col("x").cast("long")).alias("libsize"))
    if samples is None:
        return sums
    return samples.select("sample_idx").join(sums, "sample_idx", "left").withColumn("libsize", F.coalesce("libsize", F.lit(0)))


def median_library_size(sizes: DataFrame) -> DataFrame:
    """n, median_libsize; an even number of samples gives the integer mean of the middle two."""
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.floor(F.percentile("libsize", F.lit(0.5))).cast("long").alias("median_libsize"))


def transformed(cells: DataFrame, method: int, scale_factor: float = 1.0, samples: DataFrame | None = None) -> DataFrame:
    """Cells after the method's transform, before they are standardised."""
    if method in (0, 1):
        return cells.select("feature_idx", "sample_idx", F.col("x").cast("double").alias("x"))
    if method not in (2, 3, 4):
        raise ValueError("scale must be 0 to 4")
    sizes = library_sizes(cells, samples)
    rows = cells.join(sizes, "sample_idx")
    share = F.col("x") / F.col("libsize")
    if method == 2:
        # one row
        rows = rows.crossJoin(F.broadcast(median_library_size(sizes).select("median_libsize")))
        x = F.log10(F.col("x") * (F.col("median_libsize") / F.col("libsize")) + 1)
    else:
        x = F.log1p(share * scale_factor) if method == 3 else share * scale_factor
    return rows.select("feature_idx", "sample_idx", x.alias("x"))


def feature_moments(cells: DataFrame, n_samples: int, features: DataFrame | None = None) -> DataFrame:
    """feature_idx, mean, sd (n - 1) over all samples, stored or not."""
    n = F.lit(float(n_samples))
    sums = cells.groupBy("feature_idx").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("c"))
    mean = sums.select("feature_idx", (F.col("s") / n).alias("mean"), "c")
    square = cells.join(mean, "feature_idx").groupBy("feature_idx", "mean", "c").agg(F.sum(F.pow(F.col("x") - F.col("mean"), 2)).alias("ss"))
    whole = F.col("ss") + (n - F.col("c")) * F.col("mean") * F.col("mean")
    moments = square.select("feature_idx", "mean", F.sqrt(whole / (n - 1)).alias("sd"))
    return moments if features is None else features.select("feature_idx").join(moments, "feature_idx", "left").na.fill(0.0, ["mean", "sd"])


def scaled(
    cells: DataFrame, samples: DataFrame, method: int, scale_factor: float = 1.0, dense: bool = True, features: DataFrame | None = None
) -> DataFrame:
    """feature_idx, sample_idx, x after the method."""
    rows = transformed(cells, method, scale_factor, samples)
    if method == 0:
        return rows
    moments = feature_moments(rows, samples.count(), features)
    if dense:
        # the full matrix: each feature's row of moments is dealt out to all samples of the matrix
        everyone = samples.agg(F.collect_list("sample_idx").alias("all"))
        grid = moments.crossJoin(F.broadcast(everyone)).select("feature_idx", "mean", "sd", F.explode("all").alias("sample_idx"))
        rows = grid.join(rows, ["feature_idx", "sample_idx"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    else:
        rows = rows.join(moments, "feature_idx")
    z = F.col("x") - F.col("mean")
    return rows.select("feature_idx", "sample_idx", F.when(F.col("sd") > SD_TOL, z / F.col("sd")).otherwise(z).alias("x"))


# --- rows of arrays -----------------------------------------------------------------------------


def row_library_sizes(rows: DataFrame, n: int) -> np.ndarray:
    """Integer sums over features of rows (feature_idx, values): n numbers."""

    def partial(_, x, total):
        total["s"] += x.astype(np.int64).sum(0)[:, None]

    return reduce_arrays(rows, partial, {"s": (n, 1)})["s"][:, 0]


def _transform(x: np.ndarray, sizes: np.ndarray, method: int, factor: float) -> np.ndarray:
    if method == 1:
        return x
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(x == 0, 0.0, x / sizes)
    if method == 2:
        return np.log10(share * float(np.floor(np.median(np.floor(sizes.ravel())))) + 1) if sizes.size else x
    return np.log1p(share * factor) if method == 3 else share * factor


def _check(method: int) -> None:
    if method not in (1, 2, 3, 4):
        raise ValueError("scale must be 0 to 4")


def scaled_rows(rows: DataFrame, n: int, method: int, scale_factor: float = 1.0) -> DataFrame:
    """feature_idx, values after the method: a row stays where it is, and only n library sizes are sent to the tasks."""
    if method == 0:
        return rows.select("feature_idx", "values")
    _check(method)

    def run(x, shared):
        sizes, method, factor = shared
        x = _transform(x, sizes, method, factor)
        z = x - x.mean(1, keepdims=True)
        sd = np.sqrt((z * z).sum(1, keepdims=True) / max(n - 1, 1))
        return (np.where(sd > SD_TOL, z / np.where(sd > SD_TOL, sd, 1), z),)

    shared = (row_library_sizes(rows, n) if method > 1 else np.zeros(n), method, scale_factor)
    return map_arrays(rows.select("feature_idx", "values"), run, shared, "feature_idx long, values array<double>")
