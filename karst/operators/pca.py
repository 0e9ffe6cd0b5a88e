"""Leading singular triplets of a features-by-samples matrix.

Rows are (feature_idx, values), values over N samples. U (N x k) and S live on the driver; V stays
a DataFrame (feature_idx, pcs). Each method is a driver loop of passes; see matrix.power_pass.

A matrix X of few features and more samples (`slices.few`) is L Q', with L from the features' relation
X X' = L L' and orthonormal Q (samples). The methods then run on L, which is small, from the same start:
their steps are those on X, written in the coordinates of Q. Scores are made in slices of samples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators.lineage import cut
from karst.operators.matrix import align, flip_signs, mev, power_pass, reduce_arrays, times
from karst.operators.slices import Slices, few_features, slices
from karst.operators.tiles import gram
from karst.params import PcaParams


@dataclass
class Pca:
    """Scores u (samples x k), singular values s, loadings v (feature_idx, pcs), passes over the data."""

    u: np.ndarray
    s: np.ndarray
    v: DataFrame
    n_features: int
    passes: int = 0

    def eigenvalues(self, ploidy: int = 2) -> np.ndarray:
        return self.s**2 / self.n_features * ploidy


class SlicedPca:
    """A model of a matrix in slices: U is X' times `coefs` (features x k), and made when it is asked for."""

    eigenvalues = Pca.eigenvalues

    def __init__(self, parts: Slices, relation: np.ndarray, coefs: np.ndarray, s: np.ndarray, passes: int):
        self.parts, self.coefs, self.s, self.passes = parts, coefs, s, passes
        self.n_features = len(parts.features)
        #: X U, and V without its signs (features x k)
        self.images = relation @ coefs
        self.loadings = self.images / np.where(s > 0, s, 1.0)

    @cached_property
    def _signed(self) -> tuple[np.ndarray, np.ndarray]:
        u = self.parts.scores(lambda _, cols, a: cols[0].T @ a, self.coefs, len(self.s))
        sign = flip_signs(u)
        return u * sign, self.loadings * sign

    @property
    def u(self) -> np.ndarray:
        return self._signed[0]

    @cached_property
    def v(self) -> DataFrame:
        rows = [(int(i), [float(x) for x in r]) for i, r in zip(self.parts.features, self._signed[1])]
        return self.parts.table.sparkSession.createDataFrame(rows, "feature_idx long, pcs array<double>")


class Reduced:
    """The small matrix that stands for one in slices: X = L Q'."""

    def __init__(self, parts: Slices):
        self.parts, self.relation = parts, parts.relation()
        w, e = np.linalg.eigh(self.relation)
        good = w > max(w.max(), 0) * 1e-13
        size = np.sqrt(w[good])
        self.l, self.q = e[:, good] * size, e[:, good] / size

    def fit(self, u: np.ndarray, s: np.ndarray, passes: int) -> SlicedPca:
        """The model of scores in the coordinates of Q."""
        return SlicedPca(self.parts, self.relation, self.q @ u, s, passes)

    def start(self, p: PcaParams, start=None) -> np.ndarray:
        """The methods' start in the coordinates of Q; `start` is a broadcast of it over samples."""
        return self.q.T @ self.parts.times(start or sent_start(self.parts, p))


def sent_start(parts: Slices, p: PcaParams):
    """The start over samples, broadcast (8 N l bytes)."""
    n = parts.n
    return parts.broadcast(orthonormal(start_matrix(n, start_width(p, n, len(parts.features)), p.seed, p.omega)))


def start_width(p: PcaParams, n: int, m: int) -> int:
    return min(p.k + p.oversamples, n, m)


def start_matrix(n: int, width: int, seed: int, kind: str = "gaussian") -> np.ndarray:
    """The random start of the range finders."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, width)) if kind == "gaussian" else rng.uniform(-1, 1, (n, width))


def orthonormal(h: np.ndarray) -> np.ndarray:
    return np.linalg.qr(h)[0]


def extract(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U and S from H = X'G and C = G'G, G = X omega: with C = R'R, B = R^-T H' has X's singular triplets
    in the range of G. R comes from C's eigenvectors, which serves where C is singular too."""
    w, e = np.linalg.eigh(c)
    good = w > max(w.max(), 0) * 1e-13 if len(w) else np.zeros(0, bool)
    b = (e[:, good] / np.sqrt(w[good])).T @ h.T
    _, s, ut = np.linalg.svd(b, full_matrices=False)
    return ut.T, s


def compute_u(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return extract(h, c)[0]


def _finish(rows: DataFrame, u: np.ndarray, s: np.ndarray, m: int, passes: int) -> Pca:
    sign = flip_signs(u)
    u = u * sign
    v = times(rows, u / np.where(s > 0, s, 1.0))
    return Pca(u, s, v, m, passes)


def shape(rows: DataFrame) -> tuple[int, int]:
    """Features and samples."""
    got = rows.agg(F.count(F.lit(1)).alias("m"), F.max(F.size("values")).alias("n")).first()
    return got["m"], got["n"] or 0


def full(rows: DataFrame, k: int | None = None) -> Pca:
    """The k leading triplets (all, where k is None), from the relation of the samples as a table of tiles."""
    found = few_features(rows)
    if found:
        small = Reduced(slices(rows, *found))
        u, s, _ = np.linalg.svd(small.l.T, full_matrices=False)
        return small.fit(u[:, :k], s[:k], 1)
    m, n = shape(rows)
    w, u = gram(rows, n).leading(min(n, m, k or n))
    return _finish(rows, u, np.sqrt(np.maximum(w, 0)), m, 1)


def ssvd(rows: DataFrame, p: PcaParams) -> Pca:
    """Power iteration, a pass each, until the leading scores stay."""
    found = few_features(rows)
    if found:
        return sliced_ssvd(slices(rows, *found), p)
    m, n = shape(rows)
    omega = orthonormal(start_matrix(n, start_width(p, n, m), p.seed, p.omega))
    u, s, done = _power(lambda omega: power_pass(rows, omega), omega, p)
    return _finish(rows, u, s, m, done)


def sliced_ssvd(parts: Slices, p: PcaParams, start=None) -> SlicedPca:
    small = Reduced(parts)

    def one_pass(omega):
        g = small.l @ omega
        return small.l.T @ g, g.T @ g

    return small.fit(*_power(one_pass, small.start(p, start), p))


def _power(one_pass: Callable, omega: np.ndarray, p: PcaParams) -> tuple[np.ndarray, np.ndarray, int]:
    """U, S and passes of power iteration from omega; one_pass gives X' X omega and omega' X' X omega."""
    before = None
    for done in range(1, p.max_power + 1):
        h, c = one_pass(omega)
        u, s = extract(h, c)
        k = min(p.k, u.shape[1])
        now = u[:, :k]
        if done == p.max_power or before is not None and before.shape == now.shape and 1 - mev(now, before) < p.tol_rsvd:
            break
        before, omega = now, orthonormal(h)
    return now, s[:k], done


def with_bands(rows: DataFrame, bands: int, shuffle: bool, seed: int) -> DataFrame:
    """Rows with the band they belong to: a hash of the feature, or contiguous ranges."""
    if shuffle:
        return rows.withColumn("band", F.pmod(F.xxhash64("feature_idx", F.lit(seed)), F.lit(bands)).cast("int"))
    top = rows.agg(F.max("feature_idx")).first()[0] or 0
    return rows.withColumn("band", F.least(F.floor(F.col("feature_idx") * bands / (top + 1)), F.lit(bands - 1)).cast("int"))


def update_points(bands: int, epoch: int) -> list[int]:
    """How many bands are read when omega is renewed in an epoch, whose span is 2, 4, 8, ... bands.

    At the end of the first span and at each half span after it; once also after a quarter of the
    first span, with the last half span of the epoch before, as long as a span has to grow.
    """
    span = min(2 << epoch, bands)
    early = [span // 4] if epoch and 1 << epoch < bands else []
    return early + list(range(span, bands + 1, span // 2))


def half_spans(part: DataFrame, omega: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over rows with a band, G = X omega: X'G of the bands before `half`, X'G of the others, and G'G."""
    n, width = omega.shape
    shared = part.sparkSession.sparkContext.broadcast(np.ascontiguousarray(omega))

    def partial(band, x, total):
        g = x @ shared.value
        first = band < half
        total["early"] += x[first].T @ g[first]
        total["late"] += x[~first].T @ g[~first]
        total["c"] += g.T @ g

    got = reduce_arrays(part.select(F.col("band").alias("feature_idx"), "values"), partial, {"early": (n, width), "late": (n, width), "c": (width, width)})
    return got["early"], got["late"], got["c"]


def winsvd(rows: DataFrame, p: PcaParams) -> Pca:
    """Power iteration that renews omega within a pass (see update_points).

    Omega is made from the products of the latest two half spans; its columns are turned to point
    like those before, as the products of different omegas are added. A step reads its own bands
    only: the rows are written once, by band. Once a span is all bands, an epoch is an exact pass, and
    the scores are compared with those of the epoch before.
    """
    found = few_features(rows)
    if found:
        return sliced_winsvd(slices(rows, *found), p)
    m, n = shape(rows)
    table = cut(with_bands(rows, p.windows, p.shuffle, p.seed).repartition(p.windows, "band"), "bands")
    omega = orthonormal(start_matrix(n, start_width(p, n, m), p.seed, p.omega))

    def halves(at, to, omega, half):
        part = table if to - at == p.windows else table.filter((F.col("band") >= at) & (F.col("band") < to))
        return half_spans(part, omega, half)

    u, s, epoch = _windows(halves, omega, p)
    return _finish(rows, u, s, m, epoch)


def sliced_winsvd(parts: Slices, p: PcaParams) -> SlicedPca:
    """Columns of omega are turned in the coordinates of Q; the features' bands need no table."""
    small = Reduced(parts)
    rows = parts.table.sparkSession.createDataFrame([(int(i),) for i in parts.features], "feature_idx long")
    told = {r["feature_idx"]: r["band"] for r in with_bands(rows, p.windows, p.shuffle, p.seed).collect()}
    band = np.array([told[i] for i in parts.features])

    def halves(at, to, omega, half):
        g = small.l @ omega
        early, late, both = (band >= at) & (band < half), (band >= max(at, half)) & (band < to), (band >= at) & (band < to)
        return small.l[early].T @ g[early], small.l[late].T @ g[late], g[both].T @ g[both]

    return small.fit(*_windows(halves, small.start(p), p))


def _windows(halves: Callable, omega: np.ndarray, p: PcaParams) -> tuple[np.ndarray, np.ndarray, int]:
    """U, S and epochs from omega; halves(at, to, omega, half) gives the sums of half_spans over bands from `at` before `to`."""
    none = np.zeros(omega.shape)
    older, before, epoch = none, None, 0
    while True:
        exact = 1 << epoch >= p.windows
        span = min(2 << epoch, p.windows)
        older = none if exact else older
        first, c, at = none, 0.0, 0
        for to in update_points(p.windows, epoch):
            early, late, own = halves(at, to, omega, span // 2 if at < span else 0)
            c, first = c + own, first + early
            if to < span:
                h, older = older + first, none
            else:
                h, older = (first + late if to == span else older + late), late
            omega = align(omega, orthonormal(h))
            at = to
        u, s = extract(h, c)
        k = min(p.k, u.shape[1])
        now = u[:, :k]
        epoch += 1
        same = before is not None and before.shape == now.shape and 1 - mev(now, before) < p.tol_rsvd
        if exact and (same or epoch >= p.max_power):
            return now, s[:k], epoch
        before = now


def iram(rows: DataFrame, p: PcaParams) -> Pca:
    """Lanczos on X'X with full reorthogonalisation; a matrix-vector product is one pass.

    Fails unless k pairs converge within lanczos_iter products; restarts keep the wanted vectors.
    """
    m, n = shape(rows)
    k = min(p.k, n, m)
    ncv = min(p.ncv, n)
    rng = np.random.default_rng(p.seed)

    def product(x: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(x)

        def partial(_, block_, total):
            total["y"] += (block_.T @ (block_ @ shared.value))[:, None]

        return reduce_arrays(rows, partial, {"y": (n, 1)})["y"][:, 0]

    basis = np.zeros((n, 0))
    image = np.zeros((n, 0))
    x = rng.standard_normal(n)
    done = 0
    while True:
        while basis.shape[1] < ncv:
            for _ in range(2):
                x = x - basis @ (basis.T @ x)
            norm = np.linalg.norm(x)
            if norm < 1e-12:
                x = rng.standard_normal(n)
                x = x - basis @ (basis.T @ x)
                norm = np.linalg.norm(x)
            q = x / norm
            y = product(q)
            done += 1
            basis, image = np.column_stack([basis, q]), np.column_stack([image, y])
            x = y
            if done >= p.lanczos_iter:
                break
        t = basis.T @ image
        w, e = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-w)
        w, e = w[order], e[:, order]
        ritz, image_r = basis @ e, image @ e
        rest = np.linalg.norm(image_r[:, :k] - ritz[:, :k] * w[:k], axis=0)
        if (rest <= p.lanczos_tol * np.maximum(np.abs(w[:k]), 1e-23)).all() or basis.shape[1] >= n:
            break
        if done >= p.lanczos_iter:
            raise RuntimeError(f"only {(rest <= p.lanczos_tol * np.abs(w[:k])).sum()} of {k} pairs converged")
        keep = min(ncv - 1, k + (ncv - k) // 2)
        worst = int(np.argmax(rest))
        basis, image = ritz[:, :keep], image_r[:, :keep]
        x = image_r[:, worst] - ritz[:, worst] * w[worst]
    return _finish(rows, ritz[:, :k], np.sqrt(np.maximum(w[:k], 0)), m, done)


METHODS: dict[str, Callable[[DataFrame, PcaParams], Pca]] = {
    "full": lambda rows, p: full(rows, p.k),
    "iram": iram,
    "ssvd": ssvd,
    "winsvd": winsvd,
}


def pca(rows: DataFrame, p: PcaParams | None = None) -> Pca:
    p = p or PcaParams()
    return METHODS[p.method](rows, p)


def rsvd(rows: DataFrame, k: int, oversamples: int = 0, p: int = 20, windows: int = 0, seed: int = 101) -> Pca:
    """Randomised SVD of any rows: `windows` 0 for plain power iteration."""
    return pca(rows, PcaParams(k=k, oversamples=oversamples, max_power=p, seed=seed, method="winsvd" if windows else "ssvd", windows=windows or 8))
