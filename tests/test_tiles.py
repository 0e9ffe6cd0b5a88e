"""Relations as tables of tiles, block Lanczos, the schedule of windows, and agreement of tables, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.operators import ldstats, matrix, pca, tiles
from karst.params import PcaParams


def rows_of(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "feature_idx long, values array<double>").repartition(parts)


@pytest.mark.parametrize("n,tile,sum_bytes", [(30, 512, 1 << 20), (30, 7, 1 << 20), (30, 7, 2000), (30, 7, 1), (1, 4, 100)])
def test_gram(spark, n, tile, sum_bytes):
    x = np.random.default_rng(n).standard_normal((50, n))
    got = tiles.gram(rows_of(spark, x, 5), n, tile, sum_bytes)
    g = x.T @ x
    assert np.allclose(got.dense(), g)
    assert got.table.count() == len(range(0, n, tile)) * (len(range(0, n, tile)) + 1) // 2
    q = np.random.default_rng(1).standard_normal((n, 3))
    assert np.allclose(got.product(q), g @ q)
    d = np.arange(n, dtype=float)
    other = got.with_diagonal(d)
    assert np.allclose(other.dense(), g - np.diag(np.diag(g)) + np.diag(d))
    assert tiles.inner(got, other) == pytest.approx((g * other.dense()).sum())
    cells = {(r["i"], r["j"]): r["c"] for r in got.cells([10 * i for i in range(n)]).collect()}
    assert len(cells) == n * n and all(cells[10 * i, 10 * j] == pytest.approx(g[i, j]) for i in range(n) for j in range(n))
    lines = got.lines().orderBy("i").collect()
    assert np.allclose(np.array([r["values"] for r in lines]), g)


def test_no_rows(spark):
    empty = rows_of(spark, np.zeros((2, 4))).limit(0)
    got = tiles.gram(empty, 4)
    assert got.table.count() == 0 and not got.dense().any() and not got.product(np.ones((4, 1))).any()


@pytest.mark.parametrize("m,n,k", [(200, 60, 4), (20, 60, 30), (90, 60, 60), (200, 60, 1)])
def test_full_without_the_whole_relation(spark, monkeypatch, m, n, k):
    """No place holds N x N: dense() refuses, and the triplets are numpy's."""
    monkeypatch.setattr(tiles, "SMALL", 8)
    rng = np.random.default_rng(m)
    x = rng.standard_normal((m, n)) * np.linspace(3, 0.1, n) + rng.standard_normal((m, 1))
    fit = pca.full(rows_of(spark, x), k)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    k = min(k, m, n)
    assert np.allclose(fit.s, s[:k], rtol=1e-6, atol=1e-5 * s[0])
    some = min(k, 5)
    assert np.allclose(np.abs((fit.u[:, :some] * vt[:some].T).sum(0)), 1, atol=1e-6)
    with pytest.raises(ValueError, match="held whole"):
        tiles.gram(rows_of(spark, x), n, 16).dense()


def test_block_lanczos_with_equal_values():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    w = np.concatenate([[9, 9, 9, 5, 5, 2], np.linspace(1, 0, 294)])
    a = q * w @ q.T
    got, u = tiles.block_lanczos(lambda x: a @ x, 300, 6)
    assert np.allclose(got, w[:6]) and np.allclose(u.T @ u, np.eye(6), atol=1e-8)
    assert np.allclose(a @ u, u * got, atol=1e-6)
    zero, _ = tiles.block_lanczos(lambda x: 0 * x, 40, 3)
    assert not zero.any()


def test_cross_chromosome(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((30, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sites = spark.range(30).select(F.col("id").alias("feature_idx"), F.when(F.col("id") < 18, "1").otherwise("2").alias("chr"))
    got = ldstats.cross_chromosome(rows_of(spark, x), sites, "1", "2").first()[0]
    assert got == pytest.approx(((x[:18] @ x[18:].T) ** 2).mean())
    assert ldstats.cross_chromosome(rows_of(spark, x), sites, "1", "7").first()[0] == 0


def test_schedule_of_windows():
    per_epoch = [len(pca.update_points(64, e)) for e in range(7)]
    assert per_epoch == [63, 32, 16, 8, 4, 2, 1] and sum(per_epoch) == 126
    assert pca.update_points(8, 0) == [2, 3, 4, 5, 6, 7, 8]
    assert pca.update_points(8, 1) == [1, 4, 6, 8]
    assert pca.update_points(8, 2) == [2, 8]
    assert pca.update_points(8, 3) == pca.update_points(8, 4) == [8]


def plain_windows(x, band, p, epochs):
    """The schedule on a matrix in memory: sums of the latest two half spans, band by band."""
    n = x.shape[1]
    width = min(p.k + p.oversamples, *x.shape)
    omega = pca.orthonormal(pca.start_matrix(n, width, p.seed, p.omega))
    h1, h2 = np.zeros((n, width)), np.zeros((n, width))
    for e in range(epochs):
        span, i, c = min(2 << e, p.windows), 0, 0
        if 1 << e >= p.windows:
            h1, h2 = np.zeros((n, width)), np.zeros((n, width))
        for b in range(p.windows):
            own = x[band == b]
            g = own @ omega
            c, i = c + g.T @ g, i + 1
            if i <= span // 2:
                h1 = h1 + own.T @ g
            else:
                h2 = h2 + own.T @ g
            if b + 1 in pca.update_points(p.windows, e):
                h = h1 + h2
                omega = matrix.align(omega, pca.orthonormal(h))
                if i == span:
                    h1, i = np.zeros((n, width)), 0
                else:
                    h2 = np.zeros((n, width))
    return pca.extract(h, c)


@pytest.mark.parametrize("windows", [4, 16, 64])
def test_windows_against_one_machine(spark, monkeypatch, windows):
    rng = np.random.default_rng(windows)
    x = rng.standard_normal((700, 25)) + 4 * rng.standard_normal((700, 3)) @ rng.standard_normal((3, 25))
    p = PcaParams(k=3, oversamples=4, windows=windows, tol_rsvd=1e-4)
    rows = rows_of(spark, x)
    band = np.array([r["band"] for r in pca.with_bands(rows, windows, True, p.seed).orderBy("feature_idx").collect()])
    updates = []
    plain = pca.half_spans
    monkeypatch.setattr(pca, "half_spans", lambda *a: updates.append(1) or plain(*a))
    fit = pca.winsvd(rows, p)
    u, s = plain_windows(x, band, p, fit.passes)
    assert np.allclose(fit.s, s[:3], rtol=1e-9) and matrix.mev(u[:, :3], fit.u) == pytest.approx(1, abs=1e-9)
    assert np.allclose(fit.s, np.linalg.svd(x)[1][:3], rtol=1e-4)
    assert len(updates) == sum(len(pca.update_points(windows, e)) for e in range(fit.passes))
    if windows == 64:
        assert fit.passes == 7 and len(updates) == 126


def test_agreement(spark):
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((40, 3)), rng.standard_normal((40, 3))
    y[:, 1] = -x[:, 1] + 0.01 * y[:, 1]
    table = lambda a: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(a)], "feature_idx long, pcs array<double>")
    got = matrix.agreement(table(x), table(y), 3)
    assert got["mev"] == pytest.approx(matrix.mev(x, y)) and got["rmse"] == pytest.approx(matrix.rmse(x, y))
    assert np.allclose(got["min_sse"], matrix.min_sse(x, y))


def test_cumulative_mean_and_running_max(spark):
    v = np.random.default_rng(3).standard_normal(500)
    rows = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v)], "i long, v double").repartition(4)
    mean = [r["v"] for r in ldstats.cumulative_mean(rows, "i", "v").orderBy("i").collect()]
    assert np.allclose(mean, np.cumsum(v) / np.arange(1, 501))
    top = [r["v"] for r in ldstats.running_max(rows, "i", "v", width=50).orderBy("i").collect()]
    assert np.allclose(top, [abs(v[max(0, i - 25) : i + 25].max()) for i in range(500)])
