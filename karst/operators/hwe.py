"""Hardy-Weinberg tests and inbreeding along individual allele frequencies.

Long form: cells (feature_idx, sample_idx, p0, p1, pi), likelihoods of 0 and 1 copies and the
individual frequency. Row form: feature_idx and an array of each over the samples, in one order. Steps
work a feature's row where it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions.special import chi_square_tail
from karst.operators.frequency import field
from karst.operators.lineage import cut, drop
from karst.operators.matrix import block, map_arrays

FLOOR = 1e-4


def individual_frequencies(v: DataFrame, u: DataFrame, s: DataFrame, af: DataFrame) -> DataFrame:
    """feature_idx, sample_idx, pi = clamp((U S V' + 2 af) / 2, 1e-4, 1 - 1e-4) from long-form U, S, V.

    A feature's row is its loadings times U S, which is broadcast (8 N k bytes); cells are made where the row is.
    """
    return model_rows(v, u, s, af.select("feature_idx", "af")).select("feature_idx", "sample_idx", "pi")


def model_rows(v: DataFrame, u: DataFrame, s: DataFrame, af: DataFrame) -> DataFrame:
    """feature_idx, sample_idx, x = U S V', pi in long form."""
    ids, us = score_matrix(u, s)
    rows = loading_rows(v).join(af, "feature_idx").select("feature_idx", "w", "af")

    def run(w, f, shared):
        x = w @ shared.T
        return x, np.clip((x + 2 * f[:, None]) / 2, FLOOR, 1 - FLOOR)

    made = map_arrays(rows, run, us, "feature_idx long, x array<double>, pi array<double>")
    return cells_of(made, ["x", "pi"], ids)


def with_frequencies(rows: DataFrame, us: np.ndarray) -> DataFrame:
    """feature_idx, p0, p1, pi of rows (feature_idx, p0, p1, w, af); U S is broadcast."""

    def run(p0, p1, w, af, shared):
        return p0, p1, np.clip((w @ shared.T + 2 * af[:, None]) / 2, FLOOR, 1 - FLOOR)

    return map_arrays(rows.select("feature_idx", "p0", "p1", "w", "af"), run, us, "feature_idx long, p0 array<double>, p1 array<double>, pi array<double>")


def score_matrix(u: DataFrame, s: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sample ids in order, and U S (samples x k) of long-form U and S."""
    scale = [r["s"] for r in s.orderBy("k").collect()]
    rows = u.groupBy("sample_idx").agg(F.array_sort(F.collect_list(F.struct("k", "u"))).alias("c"))
    got = rows.select("sample_idx", F.transform("c", lambda c: c["u"]).alias("u")).orderBy("sample_idx").toArrow()
    return got.column("sample_idx").to_numpy(), block(got.column("u").combine_chunks()) * np.array(scale)


def loading_rows(v: DataFrame) -> DataFrame:
    """feature_idx, w: loadings in the order of k."""
    rows = v.groupBy("feature_idx").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c"))
    return rows.select("feature_idx", F.transform("c", lambda c: c["v"]).alias("w"))


def cells_of(rows: DataFrame, names: list[str], ids: np.ndarray) -> DataFrame:
    """Long form of arrays over the samples `ids`."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(ids, np.int64))

    def run(batches):
        for b in batches:
            if len(b):
                n = len(shared.value)
                cols = [b.column(b.schema.get_field_index(c)).flatten() for c in names]
                idx = np.repeat(b.column(0).to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(np.tile(shared.value, len(b))), *cols], ["feature_idx", "sample_idx", *names])

    return rows.select("feature_idx", *names).mapInArrow(run, "feature_idx long, sample_idx long, " + ", ".join(f"{c} double" for c in names))


def cell_rows(cells: DataFrame) -> DataFrame:
    """feature_idx, p0, p1, pi as arrays of long-form cells (feature_idx, sample_idx, p0, p1, pi)."""
    rows = cells.groupBy("feature_idx").agg(F.collect_list(F.struct("p0", "p1", "pi")).alias("c"))
    return rows.select("feature_idx", *[F.transform("c", field(n)).alias(n) for n in ("p0", "p1", "pi")])


def p_value(lrt: DataFrame) -> DataFrame:
    """Add p: the chi-square upper tail with one degree of freedom; nan gives 1."""
    return lrt.withColumn("p", chi_square_tail(F.col("lrt")))


def _prior_arrays(pi: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, c = 1 - pi, f[:, None]
    raw = [np.maximum(x, FLOOR) for x in (q * q + pi * q * c, 2 * pi * q * (1 - c), pi * pi + pi * q * c)]
    total = raw[0] + raw[1] + raw[2]
    return raw[0] / total, raw[1] / total, raw[2] / total


def next_coefficients(p0: np.ndarray, p1: np.ndarray, pi: np.ndarray, f: np.ndarray) -> np.ndarray:
    """One step of the coefficients of features (rows) from f."""
    a, b, c = _prior_arrays(pi, f)
    w0, w1, w2 = p0 * a, p1 * b, (1 - p0 - p1) * c
    return np.clip(1 - (w1 / (w0 + w1 + w2)).sum(1) / (2 * pi * (1 - pi)).sum(1), -1, 1)


def ratio(p0: np.ndarray, p1: np.ndarray, pi: np.ndarray, f: np.ndarray) -> np.ndarray:
    """2 (log-likelihood at f - at 0) of features."""

    def log_l(at):
        a, b, c = _prior_arrays(pi, at)
        return np.log(p0 * a + p1 * b + (1 - p0 - p1) * c).sum(1)

    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (log_l(f) - log_l(np.zeros(len(f))))


def coefficients(rows: DataFrame, steps: int) -> DataFrame:
    """feature_idx, f after `steps` plain steps from 0, and its lrt, of rows (feature_idx, p0, p1, pi)."""

    def run(p0, p1, pi, _):
        f = np.zeros(len(p0))
        for _i in range(steps):
            f = next_coefficients(p0, p1, pi, f)
        return f, ratio(p0, p1, pi, f)

    return map_arrays(rows.select("feature_idx", "p0", "p1", "pi"), run, None, "feature_idx long, f double, lrt double")


@dataclass
class Inbreeding:
    table: DataFrame  # feature_idx, f, lrt, p
    iterations: int


def inbreeding(rows: DataFrame, max_iter: int = 100, tol: float = 1e-5) -> Inbreeding:
    """Accelerated EM (SQUAREM) of the coefficients of rows (feature_idx, p0, p1, pi); the step length is one number for all features.

    An iteration is one pass: it leaps from the last two steps' coefficients, and makes the two steps after
    it. The state is a row per feature, written after each pass; Spark broadcasts it while it is small.
    """
    rows = cut(rows.select("feature_idx", "p0", "p1", "pi"), "hwe-rows")

    def first(p0, p1, pi, _):
        f0 = np.zeros(len(p0))
        f1 = next_coefficients(p0, p1, pi, f0)
        return f0, f1, next_coefficients(p0, p1, pi, f1)

    def leap(p0, p1, pi, f0, f1, f2, a):
        d1, d2 = f1 - f0, f2 - 2 * f1 + f0
        new = next_coefficients(p0, p1, pi, np.clip(f0 + 2 * a * d1 + a * a * d2, -1, 1))
        f1 = next_coefficients(p0, p1, pi, new)
        return new, f1, next_coefficients(p0, p1, pi, f1), (new - f0) ** 2

    kind = "feature_idx long, f0 double, f1 double, f2 double"
    state = cut(map_arrays(rows, first, None, kind), "hwe")
    done, last = 0, "f0"
    for done in range(1, max_iter + 1):
        got = state.agg(F.sum(F.pow(F.col("f1") - F.col("f0"), 2)).alias("r"), F.sum(F.pow(F.col("f2") - 2 * F.col("f1") + F.col("f0"), 2)).alias("v")).first()
        r2, v2 = got["r"] or 0.0, got["v"] or 0.0
        if v2 == 0:
            last = "f2"
            break
        a = min(max((r2 / v2) ** 0.5, 1.0), 256.0)
        both = rows.join(state.select("feature_idx", "f0", "f1", "f2"), "feature_idx")
        new = cut(map_arrays(both.select("feature_idx", "p0", "p1", "pi", "f0", "f1", "f2"), leap, a, kind + ", d double"), "hwe")
        drop(state)
        state = new
        if (state.agg(F.sqrt(F.avg("d"))).first()[0] or 0.0) < tol:
            break
    f = rows.join(state.select("feature_idx", F.col(last).alias("f")), "feature_idx").select("feature_idx", "p0", "p1", "pi", "f")
    out = map_arrays(f, lambda p0, p1, pi, f, _: (f, ratio(p0, p1, pi, f)), None, "feature_idx long, f double, lrt double")
    return Inbreeding(p_value(out), done)
