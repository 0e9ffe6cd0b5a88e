"""PCA of missing and of uncertain genotypes by expectation maximisation.

Rows carry what was observed; each iteration's imputed rows are written to the shared folder, so
that the plan of an iteration is one pass over the table before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators.lineage import cut, drop
from karst.operators.matrix import block, map_arrays, reduce_arrays, rows_batch
from karst.operators.pca import Pca, SlicedPca, pca, sent_start, sliced_ssvd
from karst.operators.slices import feature_table, few_features, slices
from karst.operators.tiles import Factored, Tiles, gram
from karst.params import PcaParams


def _emu_impute(rows: DataFrame, u: np.ndarray, s: np.ndarray) -> DataFrame:
    """feature_idx, values, af, seen, pcs with unseen cells at U U' x, kept within [-af, 1 - af].

    U S V' of a truncated decomposition is U U' X, so the loadings needn't travel; pcs are those of the
    rows before, which the next iteration compares its own with.
    """

    def run(x, af, seen, shared):
        m, scale = shared
        g = x @ m
        return np.where(seen.astype(bool), x, np.clip(g @ m.T, -af[:, None], 1 - af[:, None])), af, seen.astype(bool), g / scale

    return map_arrays(
        rows.select("feature_idx", "values", "af", "seen"), run, (u, _scale(s)),
        "feature_idx long, values array<double>, af double, seen array<boolean>, pcs array<double>",
    )


def _scale(s: np.ndarray) -> np.ndarray:
    return np.where(s > 0, s, 1.0)


def loadings_agree(rows: DataFrame, fit: Pca) -> float:
    """How far the loadings of `fit` on rows (feature_idx, values, pcs) agree with pcs, those before: see matrix.mev."""
    k, n = len(fit.s), len(fit.u)
    packed = rows.select("feature_idx", F.concat("values", "pcs").alias("values"))
    m = rows.sparkSession.sparkContext.broadcast(fit.u / _scale(fit.s))

    def partial(_, x, total):
        total["c"] += (x[:, :n] @ m.value).T @ x[:, n:]

    return float(np.linalg.norm(reduce_arrays(packed, partial, {"c": (k, k)})["c"], axis=0).mean())


def seen_rows(rows: DataFrame) -> DataFrame:
    """feature_idx, values, af, seen of frequency_rows: centred rows with which cells were seen."""

    def run(dos, af, _):
        return np.nan_to_num(dos / 2 - af[:, None], nan=0.0), af, ~np.isnan(dos)

    kind = "feature_idx long, values array<double>, af double, seen array<boolean>"
    return map_arrays(rows.select("feature_idx", "dos", "af"), run, None, kind)


def emu_rows(dosage: DataFrame, af: DataFrame) -> DataFrame:
    """seen_rows of long-form dosages."""
    from karst.operators.ld import to_rows

    cells = dosage.join(af.select("feature_idx", "af"), "feature_idx")
    cells = cells.withColumn("g", F.struct(F.coalesce(F.col("dos") / 2.0 - F.col("af"), F.lit(0.0)).alias("x"), F.col("dos").isNotNull().alias("seen"), "af"))
    rows = to_rows(cells)
    return rows.select(
        "feature_idx",
        F.transform("values", lambda c: c["x"]).alias("values"),
        F.element_at("values", 1)["af"].alias("af"),
        F.transform("values", lambda c: c["seen"]).alias("seen"),
    )


def _standardise(rows: DataFrame, ploidy: int) -> DataFrame:
    sd = F.sqrt(F.lit(float(ploidy)) * F.col("af") * (1 - F.col("af")))
    return rows.select("feature_idx", F.when(sd > 1e-9, F.transform("values", lambda x: x / sd)).otherwise(F.col("values")).alias("values"))


def emu(rows: DataFrame, p: PcaParams) -> tuple[Pca, int]:
    """PCA of hard calls with missing ones; the model and the iterations that it took."""
    inner = replace(p, em=None)
    rows = cut(rows, "emu")
    found = few_features(rows) if p.method == "ssvd" else None
    if found:
        return _sliced_emu(rows, *found, inner)
    fit = pca(rows, inner)
    done = 0
    for done in range(1, p.max_iter + 1):
        new = cut(_emu_impute(rows, fit.u, fit.s), "emu")
        drop(rows)
        rows = new
        fit = pca(rows, inner)
        if 1 - loadings_agree(rows, fit) < p.tol_em:
            break
    last = cut(_standardise(_emu_impute(rows, fit.u, fit.s), p.ploidy), "emu")
    drop(rows)
    return pca(last, inner), done


def _sliced_emu(rows: DataFrame, features: np.ndarray, n: int, p: PcaParams) -> tuple[SlicedPca, int]:
    """`emu` of few features in slices of samples: a sample's cells need small matrices of the model only."""
    af = feature_table(rows, "af")
    sd = np.sqrt(p.ploidy * af * (1 - af))

    def impute(_, x, seen, shared):
        images, coefs = shared
        return np.where(seen, x, np.clip(images @ (coefs.T @ x), -af, 1 - af)), seen

    def last(at, x, seen, shared):
        x, _ = impute(at, x, seen, shared)
        return (x / np.where(sd > 1e-9, sd, 1.0),)

    parts = slices(rows, features, n, ("values", "seen"))
    start = sent_start(parts, p)
    fit = sliced_ssvd(parts, p, start)
    done = 0
    for done in range(1, p.max_iter + 1):
        new = parts.map(impute, (fit.images, fit.coefs), ["values", "seen"]).written()
        parts.drop()
        parts, before = new, fit
        fit = sliced_ssvd(parts, p, start)
        if 1 - _loadings_mev(fit, before) < p.tol_em:
            break
    made = parts.map(last, (fit.images, fit.coefs), ["values"]).written()
    parts.drop()
    return sliced_ssvd(made, p, start), done


def _loadings_mev(fit: SlicedPca, before: SlicedPca) -> float:
    return float(np.linalg.norm(fit.loadings.T @ before.loadings, axis=0).mean())


def gl_rows(gl: DataFrame, af: DataFrame) -> DataFrame:
    """feature_idx, p0, p1 (arrays over samples), af."""
    cells = gl.join(af.select("feature_idx", "af"), "feature_idx").withColumn("g", F.struct("p0", "p1", "af"))
    from karst.operators.ld import to_rows

    rows = to_rows(cells)
    return rows.select(
        "feature_idx",
        F.transform("values", lambda c: c["p0"]).alias("p0"),
        F.transform("values", lambda c: c["p1"]).alias("p1"),
        F.element_at("values", 1)["af"].alias("af"),
    )


def posterior_dosage(p0: np.ndarray, p1: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised posterior weights of 0, 1 and 2 copies at frequencies pi."""
    w0, w1, w2 = p0 * (1 - pi) ** 2, p1 * 2 * pi * (1 - pi), (1 - p0 - p1) * pi**2
    total = w0 + w1 + w2
    total = np.where(total > 0, total, 1.0)
    return w0 / total, w1 / total, w2 / total


def _pcangsd_fit(rows: DataFrame, values: DataFrame | None, fit: Pca | None) -> DataFrame:
    """Posterior mean dosage minus 2 af, and the loadings of the rows before; priors are individual frequencies
    if there is a model, else af."""
    cols = ["feature_idx", "p0", "p1", "af"]
    shared = None if fit is None else (fit.u, _scale(fit.s))
    joined = rows.select(*cols) if fit is None else rows.select(*cols).join(values.select("feature_idx", "values"), "feature_idx")

    def run(p0, p1, af, *rest):
        f = af[:, None]
        if rest[-1] is None:
            pi, pcs = np.broadcast_to(f, p0.shape), np.zeros((len(p0), 0))
        else:
            x, (m, scale) = rest
            g = x @ m
            pi, pcs = np.clip((g @ m.T + 2 * f) / 2, 1e-4, 1 - 1e-4), g / scale
        _, w1, w2 = posterior_dosage(p0, p1, pi)
        return w1 + 2 * w2 - 2 * f, pcs

    return map_arrays(joined, run, shared, "feature_idx long, values array<double>, pcs array<double>")


def covariance_diagonal(rows: DataFrame, n: int) -> np.ndarray:
    """Per sample the sum over features of E[(copies - 2 af)^2] / (2 af (1 - af)), of rows (feature_idx, p0, p1, pi, af)."""

    def squares(p0, p1, pi, af, _):
        f = af[:, None]
        w0, w1, w2 = posterior_dosage(p0, p1, pi)
        norm = 2 * f * (1 - f)
        ok = norm > 1e-9
        return (np.where(ok, (w0 * (2 * f) ** 2 + w1 * (1 - 2 * f) ** 2 + w2 * (2 - 2 * f) ** 2) / np.where(ok, norm, 1.0), 0.0),)

    def partial(_, x, total):
        total["d"] += x.sum(0)[:, None]

    each = map_arrays(rows.select("feature_idx", "p0", "p1", "pi", "af"), squares, None, "feature_idx long, values array<double>")
    return reduce_arrays(each, partial, {"d": (n, 1)})["d"][:, 0]


def pcangsd(rows: DataFrame, p: PcaParams) -> tuple[Pca, Tiles, int]:
    """PCA of genotype likelihoods: the model, the sample covariance as tiles, and the iterations.

    The covariance is G G' / M of the standardised posterior dosages, its diagonal replaced by the
    expected squares.
    """
    inner = replace(p, em=None)
    rows = cut(rows, "gl")
    found = few_features(rows.select("feature_idx", F.col("p0").alias("values"))) if p.method == "ssvd" else None
    if found:
        return _sliced_pcangsd(rows, *found, inner)
    values = cut(_pcangsd_fit(rows, None, None), "posterior")
    fit = pca(values, inner)
    done = 0
    for done in range(1, p.max_iter + 1):
        new = cut(_pcangsd_fit(rows, values, fit), "posterior")
        drop(values)
        values = new
        fit = pca(values, inner)
        if 1 - loadings_agree(values, fit) < p.tol_em:
            break
    n = len(fit.u)
    shared = rows.sparkSession.sparkContext.broadcast(fit.u)

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Standardised dosages, and the expected squares behind them."""
        m = shared.value
        for b in batches:
            if not len(b):
                continue
            x, p0, p1 = (block(b.column(i)) for i in (1, 2, 3))
            af = b.column(4).to_numpy()[:, None]
            pi = np.clip(((x @ m) @ m.T + 2 * af) / 2, 1e-4, 1 - 1e-4)
            w0, w1, w2 = posterior_dosage(p0, p1, pi)
            norm = 2 * af * (1 - af)
            ok = norm > 1e-9
            safe = np.where(ok, norm, 1.0)
            square = np.where(ok, (w0 * (2 * af) ** 2 + w1 * (1 - 2 * af) ** 2 + w2 * (2 - 2 * af) ** 2) / safe, 0.0)
            z = np.where(ok, (w1 + 2 * w2 - 2 * af) / np.sqrt(safe), 0.0)
            yield rows_batch(b.column(0), np.hstack([z, square]))

    both = rows.join(values.select("feature_idx", "values"), "feature_idx").select("feature_idx", "values", "p0", "p1", "af")
    both = cut(both.mapInArrow(expected, "feature_idx long, values array<double>"), "standardised")
    z = both.select("feature_idx", F.slice("values", 1, n).alias("values"))

    def squares(_, x, total):
        total["d"] += x[:, n:].sum(0)[:, None]

    d = reduce_arrays(both, squares, {"d": (n, 1)})["d"][:, 0] / fit.n_features
    cov = gram(z, n).scaled(1 / fit.n_features).with_diagonal(d)
    return fit, cov, done


def _sliced_pcangsd(rows: DataFrame, features: np.ndarray, n: int, p: PcaParams) -> tuple[SlicedPca, Tiles, int]:
    """`pcangsd` of few features in slices of samples; the covariance stays two factors and a diagonal."""
    af = feature_table(rows, "af")
    norm = 2 * af * (1 - af)
    ok = norm > 1e-9
    safe, m = np.where(ok, norm, 1.0), len(features)

    def priors(x, shared):
        images, coefs = shared
        return np.clip((images @ (coefs.T @ x) + 2 * af) / 2, 1e-4, 1 - 1e-4)

    def first(_, p0, p1, shared):
        _, w1, w2 = posterior_dosage(p0, p1, np.broadcast_to(af, p0.shape))
        return w1 + 2 * w2 - 2 * af, p0, p1

    def again(_, x, p0, p1, shared):
        _, w1, w2 = posterior_dosage(p0, p1, priors(x, shared))
        return w1 + 2 * w2 - 2 * af, p0, p1

    def standardised(_, x, p0, p1, shared):
        """Standardised dosages, and what the diagonal has beside their squares: the expected squares less those."""
        w0, w1, w2 = posterior_dosage(p0, p1, priors(x, shared))
        square = np.where(ok, (w0 * (2 * af) ** 2 + w1 * (1 - 2 * af) ** 2 + w2 * (2 - 2 * af) ** 2) / safe, 0.0)
        z = np.where(ok, (w1 + 2 * w2 - 2 * af) / np.sqrt(safe), 0.0)
        return z, (square - z * z).sum(0)[None, :]

    given = slices(rows, features, n, ("p0", "p1"))
    columns = ["values", "p0", "p1"]
    parts = given.map(first, None, columns).written()
    given.drop()
    start = sent_start(parts, p)
    fit = sliced_ssvd(parts, p, start)
    done = 0
    for done in range(1, p.max_iter + 1):
        new = parts.map(again, (fit.images, fit.coefs), columns).written()
        parts.drop()
        parts, before = new, fit
        fit = sliced_ssvd(parts, p, start)
        if 1 - _loadings_mev(fit, before) < p.tol_em:
            break
    made = parts.map(standardised, (fit.images, fit.coefs), ["values", "rest"])
    return fit, Factored(made.written(), 1 / m), done
