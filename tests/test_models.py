"""Invariants of the decompositions and of the iterative models."""

from unittest.mock import MagicMock

import numpy as np
import pytest

from karst.operators import em, frequency, hwe, ld, matrix, pca, project
from karst.params import PcaParams


def rows_of(spark, x, parts=3):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "feature_idx long, values array<double>").repartition(parts, "feature_idx")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 4)) @ np.diag([9, 6, 4, 2]) @ rng.standard_normal((4, 30)) + 0.1 * rng.standard_normal((120, 30))
    return x, *np.linalg.svd(x, full_matrices=False)


@pytest.mark.parametrize("method", ["full", "iram", "ssvd", "winsvd"])
def test_methods_agree_with_svd(spark, data, method):
    x, v, s, ut = data
    fit = pca.pca(rows_of(spark, x), PcaParams(k=3, method=method, windows=4, tol_rsvd=1e-10))
    assert np.allclose(fit.s[:3], s[:3], rtol=1e-5)
    assert matrix.mev(ut.T[:, :3], fit.u[:, :3]) == pytest.approx(1, abs=1e-6)
    assert np.allclose(fit.u.T @ fit.u, np.eye(3), atol=1e-8)
    assert (fit.u[np.abs(fit.u).argmax(0), range(3)] > 0).all()
    loadings = np.array([r["pcs"] for r in fit.v.orderBy("feature_idx").collect()])
    assert np.allclose(fit.u * fit.s @ loadings.T, ((ut.T[:, :3] * s[:3]) @ v[:, :3].T), atol=1e-2)


def test_partitions_do_not_matter(spark, data):
    x = data[0]
    p = PcaParams(k=2, method="ssvd")
    a, b = pca.pca(rows_of(spark, x, 1), p), pca.pca(rows_of(spark, x, 7), p)
    assert np.allclose(a.s, b.s) and np.allclose(a.u, b.u, atol=1e-8)


def test_full_keeps_the_trace(spark, data):
    fit = pca.full(rows_of(spark, data[0]))
    assert (fit.s**2).sum() == pytest.approx((data[0] ** 2).sum())


def test_passes_in_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(matrix, "BLOCK_ROWS", 7)
    omega = np.eye(30)
    assert np.allclose(matrix.power_pass(rows_of(spark, data[0]), omega)[0], data[0].T @ data[0])


def test_measures():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((9, 3)))[0]
    assert matrix.mev(q, -q) == pytest.approx(1)
    assert matrix.rmse(q, -q) == pytest.approx(0)
    assert np.allclose(matrix.min_sse(q, q[:, ::-1] * -1), 0)
    assert len(matrix.mev_rmse_by_k(q, q)) == 3


def test_params():
    assert PcaParams(method=7).method == "winsvd" and PcaParams(method=3).method == "full"
    assert PcaParams(maf=0.9).maf == pytest.approx(0.1)
    for bad in ({"windows": 6}, {"k": 0}, {"em": "x"}, {"ploidy": 3}, {"em": "emu", "method": "full"}):
        with pytest.raises(ValueError):
            PcaParams(**bad)


def genotypes(spark, seed=3, n=40, m=150, missing=0.1):
    rng = np.random.default_rng(seed)
    group = np.arange(n) % 2
    f = np.clip(rng.uniform(0.2, 0.8, m)[:, None] + np.where(group, 0.15, -0.15) * rng.choice([-1, 1], m)[:, None], 0.02, 0.98)
    g = rng.binomial(2, f)
    gone = rng.random(g.shape) < missing
    cells = [(j, i, None if gone[j, i] else int(g[j, i])) for j in range(m) for i in range(n)]
    return g, gone, group, spark.createDataFrame(cells, "feature_idx long, sample_idx long, dos long")


def test_emu_separates_groups(spark):
    g, gone, group, dosage = genotypes(spark)
    af = frequency.allele_frequency(dosage)
    fit, steps = em.emu(em.emu_rows(dosage, af), PcaParams(k=1, method="ssvd", max_iter=5))
    assert steps >= 1
    assert abs(np.corrcoef(fit.u[:, 0], group)[0, 1]) > 0.9


def test_pcangsd_covariance(spark):
    g, gone, group, dosage = genotypes(spark, missing=0.05)
    af = frequency.allele_frequency(dosage)
    fit, cov, _ = em.pcangsd(em.gl_rows(frequency.calls_to_likelihoods(dosage), af), PcaParams(k=1, method="ssvd", max_iter=3))
    top = cov.leading(1)[1][:, 0]
    assert abs(np.corrcoef(top, group)[0, 1]) > 0.9


def test_em_maf_fixed_point(spark):
    _, _, _, dosage = genotypes(spark, missing=0.0, m=20)
    af = {r["feature_idx"]: r["af"] for r in frequency.allele_frequency(dosage).collect()}
    got = {r["feature_idx"]: r["af"] for r in frequency.em_maf(frequency.calls_to_likelihoods(dosage)).collect()}
    assert all(abs(af[k] - got[k]) < 1e-4 for k in af)


def test_inbreeding(spark):
    rng = np.random.default_rng(1)
    rows = []
    for j, f in enumerate([0.0, 1.0]):
        for i in range(200):
            g = rng.binomial(2, 0.4) if f == 0 else 2 * rng.binomial(1, 0.4)
            rows.append((j, i, float(g == 0), float(g == 1), 0.4))
    cells = spark.createDataFrame(rows, "feature_idx long, sample_idx long, p0 double, p1 double, pi double")
    got = {r["feature_idx"]: r for r in hwe.inbreeding(hwe.cell_rows(cells)).table.collect()}
    assert abs(got[0]["f"]) < 0.25 and got[1]["f"] > 0.95
    assert got[1]["lrt"] > 50 and got[1]["p"] < 1e-10 < got[0]["p"]


def test_projection_recovers_scores(spark):
    rng = np.random.default_rng(2)
    v, s, u = rng.standard_normal((50, 2)), np.array([5.0, 2.0]), rng.standard_normal((8, 2))
    g = (u * s) @ v.T
    gone = rng.random(g.shape) < 0.2
    cells = spark.createDataFrame([(j, i, None if gone[i, j] else float(g[i, j])) for i in range(8) for j in range(50)], "feature_idx long, sample_idx long, g double")
    vt = spark.createDataFrame([(j, k, float(v[j, k])) for j in range(50) for k in range(2)], "feature_idx long, k long, v double")
    st = spark.createDataFrame([(0, 5.0), (1, 2.0)], "k long, s double")
    got = {r["sample_idx"]: r["pcs"] for r in project.project(2, cells, vt, st).collect()}
    assert np.allclose([got[i] for i in range(8)], u, atol=1e-8)
    with pytest.raises(NotImplementedError):
        project.project(3)


def test_residuals_are_orthogonal(spark, data):
    x, _, _, ut = data
    got = np.array([r["values"] for r in ld.residual_rows(rows_of(spark, x), ut.T[:, :2]).collect()])
    assert np.allclose(got @ ut.T[:, :2], 0, atol=1e-8)


def test_predict_missing(spark):
    rng = np.random.default_rng(4)
    u = np.linalg.qr(rng.standard_normal((12, 2)))[0]
    x = rng.standard_normal((5, 2)) @ u.T * 0.2
    rows = spark.createDataFrame([(i, [None if j == i else float(v) for j, v in enumerate(r)], 0.5) for i, r in enumerate(x)], "feature_idx long, values array<double>, af double")
    got = {r["feature_idx"]: r["values"] for r in project.predict_missing(rows, u).collect()}
    assert np.allclose([got[i] for i in range(5)], x, atol=1e-8)


def test_prune_against_a_plain_walk(spark):
    rng = np.random.default_rng(8)
    n = 40
    sites = [(i, "1" if i < 25 else "2", 100 * (i % 25), float(rng.uniform(0.1, 0.9))) for i in range(n)]
    pairs = [(i, k, float(rng.random())) for i in range(n) for k in range(i + 1, n) if sites[i][1] == sites[k][1] and sites[k][2] - sites[i][2] <= 600]
    table = spark.createDataFrame(sites, "feature_idx long, chr string, bp long, af double")
    got = {r["feature_idx"]: r["keep"] for r in ld.prune(spark.createDataFrame(pairs, "i long, k long, r2 double"), table, 0.5).collect()}
    keep, maf = [True] * n, [min(s[3], 1 - s[3]) for s in sites]
    r2 = {(i, k): r for i, k, r in pairs}
    for i in range(n):
        if keep[i]:
            for k in range(i + 1, n):
                if keep[k] and r2.get((i, k), 0) > 0.5:
                    if maf[k] > maf[i]:
                        keep[i] = False
                    else:
                        keep[k] = False
    assert [got[i] for i in range(n)] == keep


def test_pair_products_add_up_over_slices(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((12, 23))
    sites = spark.createDataFrame([(i, "1", 10 * i) for i in range(12)], "feature_idx long, chr string, bp long")
    rows = ld.unit_rows(rows_of(spark, x))
    got = {(r["i"], r["k"]): r["r"] for r in ld.pair_products(rows, sites, 30, slice_=5).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, k): unit[i] @ unit[k] for i in range(12) for k in range(i + 1, min(12, i + 4))}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_harmonise_refuses_clashes(spark):
    ref = spark.createDataFrame([(0, "1", "rs0", 10, "A", "G")], "ref_idx long, chr string, snp_id string, bp long, a1 string, a2 string")
    target = spark.createDataFrame([(0, "1", "rs0", 11, "A", "G")], "feature_idx long, chr string, snp_id string, bp long, a1 string, a2 string")
    cells = spark.createDataFrame([(0, 0, 1)], "feature_idx long, sample_idx long, dos long")
    with pytest.raises(ValueError):
        project.harmonise(ref, target, cells)


@pytest.mark.parametrize("name", ["em_emu", "em_pcangsd", "proj_gl"])
def test_registered_models_end_by_their_tolerance(monkeypatch, name):
    """The queries leave the limit of iterations at the operators' default."""
    from karst.plans import catalog

    class Seen(Exception):
        pass

    def seen(*args, **kwargs):
        raise Seen(*[a.max_iter for a in args if isinstance(a, PcaParams)], *kwargs)

    for owner, names in ((em, ("emu", "pcangsd")), (project, ("project_likelihoods",))):
        for x in names:
            monkeypatch.setattr(owner, x, seen)
    inputs = ["dosage_rows", "likelihood_rows", "likelihoods", "model_v"]
    for owner, x in ((em, "seen_rows"), (frequency, "frequency_rows"), (catalog, "_af"), (catalog, "_s"), *((catalog.fx, x) for x in inputs)):
        monkeypatch.setattr(owner, x, MagicMock())
    with pytest.raises(Seen) as got:
        catalog.QUERIES[name](None, "")
    assert got.value.args == (() if name == "proj_gl" else (PcaParams().max_iter,))


def test_pair_products_in_blocks_of_sites(spark):
    """Blocks smaller than a bucket, against all pairs."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((70, 11))
    bp = np.sort(rng.integers(0, 90, 70))
    sites = spark.createDataFrame([(i, "1" if i < 40 else "2", int(b)) for i, b in enumerate(bp)], "feature_idx long, chr string, bp long")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, k): unit[i] @ unit[k] for i in range(70) for k in range(i + 1, 70) if (i < 40) == (k < 40) and bp[k] - bp[i] <= 25}
    for blocks in (3, 1000):
        got = ld.pair_products(ld.unit_rows(rows_of(spark, x)), sites, 25, slice_=4, sites_=blocks).collect()
        assert len(got) == len(want) and all(abs(want[r["i"], r["k"]] - r["r"]) < 1e-12 for r in got)


@pytest.mark.parametrize("width", [1, 4, 1 << 16])
def test_runs(spark, monkeypatch, width):
    monkeypatch.setattr(ld, "RANGE", width)
    rng = np.random.default_rng(width)
    rows = [(str(c), int(a), int(a + rng.integers(0, 6))) for c in (1, 2) for a in rng.integers(0, 120, 40)]
    got = ld.with_runs(spark.createDataFrame(rows, "chr string, i long, k long"), "i", "k").collect()
    want = {}
    for c in ("1", "2"):
        far, head = -1, None
        for a, b in sorted((a, b) for d, a, b in rows if d == c):
            head = a if a > far else head
            far = max(far, b)
            want[c, a] = head
    assert sorted((r["chr"], r["i"], r["k"], r["run"]) for r in got) == sorted((c, a, b, want[c, a]) for c, a, b in rows)
