"""Matrices of few features and more samples, cut across the samples, against numpy and against the way by rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from karst.operators import em, ldstats, matrix, pca, project, slices, tiles
from karst.params import PcaParams


@pytest.fixture
def small(monkeypatch):
    """Slices of a few samples, and no sums over samples or tables of tiles summed by tasks."""
    monkeypatch.setattr(slices, "SLICE_BYTES", 1)
    monkeypatch.setattr(tiles, "SMALL", 8)
    plain = slices.slices
    for owner in (pca, em, project, ldstats):
        monkeypatch.setattr(owner, "slices", lambda *a, **k: plain(*a, **({"unit": 13} | k)))
    monkeypatch.setattr(pca, "power_pass", None)
    monkeypatch.setattr(pca, "half_spans", None)
    monkeypatch.setattr(tiles, "_sums", None)


def rows_of(spark, **columns):
    names = list(columns)
    kinds = {n: "double" if np.ndim(x) == 1 else "array<boolean>" if n == "seen" else "array<double>" for n, x in columns.items()}
    rows = [(i, *(np.asarray(columns[n][i]).tolist() for n in names)) for i in range(len(columns[names[0]]))]
    return spark.createDataFrame(rows, "feature_idx long, " + ", ".join(f"{n} {kinds[n]}" for n in names)).repartition(3)


def by_rows(monkeypatch):
    for owner in (pca, em, project, tiles):
        monkeypatch.setattr(owner, "few_features", lambda rows: None)


@pytest.mark.parametrize("method", ["full", "ssvd", "winsvd"])
def test_decompositions(spark, small, method):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 90)) + 3 * rng.standard_normal((60, 2)) @ rng.standard_normal((2, 90))
    fit = pca.pca(rows_of(spark, values=x), PcaParams(k=2, method=method, windows=4, tol_rsvd=1e-9))
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(fit.s, s[:2], rtol=1e-6)
    assert matrix.mev(vt[:2].T, fit.u) == pytest.approx(1, abs=1e-6)
    v = np.array([r["pcs"] for r in fit.v.orderBy("feature_idx").collect()])
    assert np.allclose(v @ np.diag(fit.s) @ fit.u.T, u[:, :2] * s[:2] @ vt[:2], atol=1e-2)


@pytest.mark.parametrize("method", ["ssvd", "full"])
def test_same_steps_as_by_rows(spark, monkeypatch, method):
    x = np.random.default_rng(5).standard_normal((30, 47))
    p = PcaParams(k=3, method=method, max_power=4)
    got = pca.pca(rows_of(spark, values=x), p)
    by_rows(monkeypatch)
    want = pca.pca(rows_of(spark, values=x), p)
    assert np.allclose(got.s, want.s, rtol=1e-9) and np.allclose(got.u, want.u, atol=1e-7)


@pytest.mark.parametrize("tile", [7, 16])
def test_relation_is_never_written(spark, small, monkeypatch, tile):
    """Tiles come of pairs of slices; no table of them is written, and no sums are shuffled (they'd be None here)."""
    x = np.random.default_rng(tile).standard_normal((10, 40))
    got = tiles.gram(rows_of(spark, values=x), 40, tile)
    monkeypatch.setattr(tiles, "cut", None)
    monkeypatch.setattr(tiles, "SMALL", 100)
    g = x.T @ x
    assert np.allclose(got.dense(), g)
    cells = {(r["i"], r["j"]): r["c"] for r in got.cells(list(range(40))).collect()}
    assert len(cells) == 1600 and all(cells[i, j] == pytest.approx(g[i, j]) for i in range(40) for j in range(40))
    d = np.linspace(1, 50, 40)
    other = got.scaled(0.5).with_diagonal(d)
    want = g / 2 - np.diag(np.diag(g) / 2) + np.diag(d)
    q = np.random.default_rng(1).standard_normal((40, 3))
    assert np.allclose(other.dense(), want) and np.allclose(other.product(q), want @ q)
    monkeypatch.setattr(tiles, "SMALL", 8)
    assert np.allclose(other.leading(3)[0], np.linalg.eigvalsh(want)[::-1][:3])
    lines = np.array([r["values"] for r in other.lines().orderBy("i").collect()])
    assert np.allclose(lines, want)


def test_pairs_of_slices_are_dealt_to_many_tasks(spark, monkeypatch):
    """A task meets a few tiles of either side, wherever the slices are written; here one slice, in one file."""
    monkeypatch.setattr(slices, "MEET", 2)
    x = np.random.default_rng(6).standard_normal((10, 96))
    got = tiles.gram(rows_of(spark, values=x), 96, 8)
    assert got.parts.table.count() == 1
    tasks = [r["count"] for r in got.table.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 78 and len(tasks) > 9 and max(tasks) <= 16


@pytest.mark.parametrize("seed", [1, 2])
def test_mirrored_cells_take_little_disk(spark, tmp_path, seed):
    x = np.random.default_rng(seed).standard_normal((20, 700))
    got = tiles.gram(rows_of(spark, values=x), 700, 256).cells(list(range(700)))
    got.write.parquet(str(tmp_path / "cells"))
    size = sum(p.stat().st_size for p in (tmp_path / "cells").glob("*.parquet"))
    back = spark.read.parquet(str(tmp_path / "cells")).toPandas()
    assert size < 7 * 700 * 700
    assert len(back) == 700 * 700 and not back.duplicated(["i", "j"]).any()
    assert np.allclose(back.c, (x.T @ x)[back.i, back.j])


def test_cells_with_digits(spark):
    """As Spark's round: ties away from zero; no negative zero."""
    x = np.array([[1.0, 0.5, -0.5, 1e-7, -1e-7, 0.375, -2.0, 0.1]])
    got = tiles.gram(rows_of(spark, values=x), 8, 3).scaled(0.25)
    ids = [10 * i for i in range(8)]
    plain = got.cells(ids).withColumn("c", F.round("c", 2)).collect()
    rounded = got.cells(ids, 2).collect()
    want = {(r["i"], r["j"]): r["c"] + 0.0 for r in plain}
    assert {(r["i"], r["j"]): r["c"] for r in rounded} == want and len(rounded) == 64
    assert not any(r["c"] == 0 and np.signbit(r["c"]) for r in rounded)
    assert want[0, 10] == 0.13 and want[0, 20] == -0.13


def test_cross_chromosome(spark, small):
    x = np.random.default_rng(8).standard_normal((12, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sites = spark.range(12).select(F.col("id").alias("feature_idx"), F.when(F.col("id") < 5, "1").otherwise("2").alias("chr"))
    rows = rows_of(spark, values=x)
    assert ldstats.cross_chromosome(rows, sites, "1", "2").first()[0] == pytest.approx(((x[:5] @ x[5:].T) ** 2).mean())
    assert ldstats.cross_chromosome(rows, sites, "1", "7").first()[0] == 0


def test_emu_and_pcangsd(spark, small, monkeypatch):
    rng = np.random.default_rng(2)
    af = rng.uniform(0.2, 0.8, 24)
    x = np.clip(rng.standard_normal((24, 40)) / 4 + rng.standard_normal((24, 1)) * rng.standard_normal((1, 40)) / 4, -af[:, None], 1 - af[:, None])
    seen = rng.random((24, 40)) < 0.9
    likely = rng.dirichlet((1, 1, 1), (24, 40))
    p = PcaParams(k=2, method="ssvd", max_iter=4)
    calls, gl = rows_of(spark, values=np.where(seen, x, 0.0), af=af, seen=seen), rows_of(spark, p0=likely[..., 0], p1=likely[..., 1], af=af)
    fit, done = em.emu(calls, p)
    model, cov, steps = em.pcangsd(gl, p)
    w, e = cov.leading(2)
    monkeypatch.undo()
    by_rows(monkeypatch)
    want, want_done = em.emu(calls, p)
    want_model, want_cov, want_steps = em.pcangsd(gl, p)
    assert (done, steps) == (want_done, want_steps)
    assert np.allclose(fit.s, want.s, rtol=1e-9) and np.allclose(fit.u, want.u, atol=1e-7)
    assert np.allclose(model.s, want_model.s, rtol=1e-9)
    want_w, want_e = want_cov.leading(2)
    assert np.allclose(w, want_w) and np.allclose(np.abs((e * want_e).sum(0)), 1)


@pytest.mark.parametrize("steps", [None, 2])
def test_projection_of_likelihoods(spark, small, monkeypatch, steps):
    rng = np.random.default_rng(4)
    likely = rng.dirichlet((1, 1, 1), (20, 33))
    likely[3, 5] = np.nan  # a gap
    gl = rows_of(spark, p0=likely[..., 0], p1=likely[..., 1])
    w, af = rows_of(spark, w=rng.standard_normal((20, 2))), rows_of(spark, af=rng.uniform(0.2, 0.8, 20))
    with monkeypatch.context() as m:
        m.setattr(project, "reduce_arrays", None)  # no sums of all samples are sent to the driver
        got = project.project_likelihood_rows(gl, w, af, 33, 2, steps=steps)
    by_rows(monkeypatch)
    want = project.project_likelihood_rows(gl, w, af, 33, 2, steps=steps)
    assert np.allclose(got, want, atol=1e-9)


def test_batches_are_worked_in_pieces(monkeypatch):
    monkeypatch.setattr(matrix, "PIECE_BYTES", 1000)
    x = np.random.default_rng(0).standard_normal((20, 50))
    batch = matrix.rows_batch(pa.array(range(20)), x)
    got = list(matrix.pieces([batch, batch.slice(0, 0)]))
    assert len(got) > 9 and np.allclose(np.vstack([matrix.block(b.column(1)) for b in got]), x)
