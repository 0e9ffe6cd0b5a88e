"""Allele frequencies, filters, centring and genotype likelihoods, all as column expressions.

Long form: dosage (feature_idx, sample_idx, dos) with dos 0, 1, 2 or null where missing;
gl (feature_idx, sample_idx, p0, p1) with the likelihoods of no and of one copy. Row form, as files are
read: feature_idx and an array over samples for each of them; its functions (*_rows) work a row where it
is and shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.operators.matrix import block, map_arrays

VAR_TOL = 1e-9


def allele_frequency(dosage: DataFrame) -> DataFrame:
    """feature_idx, n, n_missing, af: integer sums divided once; 0 where nothing was observed."""
    sums = dosage.groupBy("feature_idx").agg(
        F.sum("dos").alias("copies"), F.count("dos").alias("n"), F.sum(F.col("dos").isNull().cast("long")).alias("n_missing")
    )
    af = F.when(F.col("n") > 0, F.col("copies").cast("double") / (2 * F.col("n"))).otherwise(F.lit(0.0))
    return sums.select("feature_idx", "n", "n_missing", af.alias("af"))


def missing_share(dosage: DataFrame) -> DataFrame:
    """The share of missing calls over all cells."""
    return dosage.agg((F.sum(F.col("dos").isNull().cast("long")) / F.count(F.lit(1))).alias("p_missing"))


def field(name: str):
    """A function for transform() that takes one field of a struct."""
    return lambda c: c[name]


def maf(af: Column) -> Column:
    return F.when(af > 0.5, 1 - af).otherwise(af)


def filter_maf(af: DataFrame, least: float) -> DataFrame:
    """Features whose minor allele frequency is above `least`, numbered anew from 0.

    One row per feature is ranked: ranges of features are counted, and the counts before a range
    are added to the rank within it, so that no task holds all features.
    """
    least = 1 - least if least > 0.5 else least
    kept = af.withColumn("maf", maf(F.col("af"))).filter(F.col("maf") > least)
    return kept.join(dense_index(kept.select("feature_idx"), "feature_idx", "new_idx"), "feature_idx")


RANGE = 1 << 16


def dense_index(rows: DataFrame, key: str, name: str, width: int = RANGE) -> DataFrame:
    """Distinct non-negative keys with their rank from 0, `width` keys a range."""
    ranged = rows.withColumn("__range", F.floor(F.col(key) / width))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # a row per range: keys / width of them
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranged.withColumn("__in", inside).join(before, "__range").select(key, (F.col("__before") + F.col("__in")).alias(name))


def centred(dosage: DataFrame, af: DataFrame) -> DataFrame:
    """g = dos / 2 - af, and 0 where missing."""
    g = F.coalesce(F.col("dos") / 2.0 - F.col("af"), F.lit(0.0))
    return dosage.join(af.select("feature_idx", "af"), "feature_idx").select("feature_idx", "sample_idx", "af", g.alias("g"))


def standardised(dosage: DataFrame, af: DataFrame, ploidy: int = 2) -> DataFrame:
    """Centred values over sqrt(ploidy af (1 - af)), where that is above VAR_TOL."""
    sd = F.sqrt(F.lit(float(ploidy)) * F.col("af") * (1 - F.col("af")))
    return centred(dosage, af).select("feature_idx", "sample_idx", F.when(sd > VAR_TOL, F.col("g") / sd).otherwise(F.col("g")).alias("g"))


def calls_to_likelihoods(dosage: DataFrame) -> DataFrame:
    """Hard calls as likelihoods; 0.333333 each where missing."""
    d, miss = F.col("dos"), F.lit(0.333333)
    return dosage.select(
        "feature_idx",
        "sample_idx",
        F.when(d.isNull(), miss).when(d == 0, 1.0).otherwise(0.0).alias("p0"),
        F.when(d.isNull(), miss).when(d == 1, 1.0).otherwise(0.0).alias("p1"),
    )


def posterior(p0: Column, p1: Column, f: Column) -> tuple[Column, Column, Column]:
    """Posterior weights of 0, 1 and 2 copies under Hardy-Weinberg frequencies, not normalised."""
    return p0 * (1 - f) * (1 - f), p1 * 2.0 * f * (1 - f), (1 - p0 - p1) * f * f


def expected_dosage(gl: DataFrame, af: DataFrame) -> DataFrame:
    """e = E[copies] - 2 af under Hardy-Weinberg priors."""
    w0, w1, w2 = posterior(F.col("p0"), F.col("p1"), F.col("af"))
    e = (w1 + 2 * w2) / (w0 + w1 + w2) - 2 * F.col("af")
    return gl.join(af.select("feature_idx", "af"), "feature_idx").select("feature_idx", "sample_idx", e.alias("e"))


def em_maf_step(gl: DataFrame, af: DataFrame) -> DataFrame:
    """One EM step of the allele frequencies."""
    w0, w1, w2 = posterior(F.col("p0"), F.col("p1"), F.col("af"))
    share = (w1 + 2 * w2) / (2 * (w0 + w1 + w2))
    return gl.join(af, "feature_idx").groupBy("feature_idx").agg(F.avg(share).alias("af"))


def em_maf(gl: DataFrame, max_iter: int = 100, tol: float = 1e-6, start: float = 0.25, steps: int | None = None) -> DataFrame:
    """Allele frequencies from likelihoods. Stops when the root mean square change falls below tol.

    `steps` asks for a fixed number of steps in one plan. Otherwise each step's frequencies (a row
    per feature) are written, so that the plan stays short.
    """
    from karst.operators.lineage import cut, drop

    af = gl.select("feature_idx").distinct().withColumn("af", F.lit(start))
    if steps is not None:
        for _ in range(steps):
            af = em_maf_step(gl, af)
        return af
    af = cut(af, "af")
    for _ in range(max_iter):
        new = cut(em_maf_step(gl, af), "af")
        change = new.alias("a").join(af.alias("b"), "feature_idx").agg(F.sqrt(F.avg(F.pow(F.col("a.af") - F.col("b.af"), 2))))
        done = (change.first()[0] or 0.0) < tol
        drop(af)
        af = new
        if done:
            break
    return af


# --- row form -----------------------------------------------------------------------------------


def frequency_rows(rows: DataFrame) -> DataFrame:
    """feature_idx, dos (missing as nan), n, af of rows (feature_idx, dos)."""

    def run(dos, _):
        n = (~np.isnan(dos)).sum(1)
        return dos, n, np.where(n > 0, np.nansum(dos, 1) / (2 * np.maximum(n, 1)), 0.0)

    doubles = rows.select("feature_idx", F.col("dos").cast("array<double>").alias("dos"))
    return map_arrays(doubles, run, None, "feature_idx long, dos array<double>, n long, af double")


def genotype_rows(rows: DataFrame, standardise: bool, ploidy: int = 2) -> DataFrame:
    """feature_idx, values of frequency_rows: dos / 2 - af, 0 where missing; over its deviation if asked for."""

    def run(dos, af, _):
        x = np.nan_to_num(dos / 2 - af[:, None], nan=0.0)
        sd = np.sqrt(ploidy * af * (1 - af))
        return (x / np.where((sd > VAR_TOL) & standardise, sd, 1.0)[:, None],)

    return map_arrays(rows.select("feature_idx", "dos", "af"), run, None, "feature_idx long, values array<double>")


def call_likelihood_rows(rows: DataFrame) -> DataFrame:
    """feature_idx, p0, p1 of hard calls."""

    def run(dos, _):
        gone = np.isnan(dos)
        return tuple(np.where(gone, 0.333333, (dos == c).astype(float)) for c in (0, 1))

    doubles = rows.select("feature_idx", F.col("dos").cast("array<double>").alias("dos"))
    return map_arrays(doubles, run, None, "feature_idx long, p0 array<double>, p1 array<double>")


def _maf_steps(p0: np.ndarray, p1: np.ndarray, start: float, steps: int) -> Iterator[np.ndarray]:
    """Frequencies before and after each EM step."""
    af = np.full(len(p0), start)
    yield af
    for _ in range(steps):
        f = af[:, None]
        w0, w1, w2 = p0 * (1 - f) ** 2, p1 * 2 * f * (1 - f), (1 - p0 - p1) * f**2
        af = ((w1 + 2 * w2) / (2 * (w0 + w1 + w2))).mean(1)
        yield af


def em_maf_rows(rows: DataFrame, max_iter: int = 100, tol: float = 1e-6, start: float = 0.25) -> DataFrame:
    """feature_idx, af of rows (feature_idx, p0, p1): as em_maf, in two passes over the rows.

    A feature's steps need that feature alone; only the step to stop at is common. The first pass adds
    up each step's changes, the second makes that many steps.
    """
    table = rows.select("feature_idx", "p0", "p1")

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, n = np.zeros(max_iter), 0
        for b in batches:
            if not len(b):
                continue
            n += len(b)
            old = None
            for i, af in enumerate(_maf_steps(block(b.column(1)), block(b.column(2)), start, max_iter)):
                own = None if old is None else float(((af - old) ** 2).sum())
                if own is not None:
                    square[i - 1] += own
                    if own <= len(b) * (tol * 1e-4) ** 2:  # the rest adds nothing that could be seen
                        break
                old = af
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(max_iter), pa.int32()), pa.array(square), pa.array([n] * max_iter, pa.int64())], ["i", "d", "n"])

    got = table.mapInArrow(changes, "i int, d double, n long").groupBy("i").agg((F.sum("d") / F.sum("n")).alias("x")).collect()
    small = [r["i"] + 1 for r in got if r["x"] ** 0.5 < tol]
    steps = min(small, default=max_iter)

    def run(p0, p1, _):
        *_, last = _maf_steps(p0, p1, start, steps)
        return (last,)

    return map_arrays(table, run, None, "feature_idx long, af double")
