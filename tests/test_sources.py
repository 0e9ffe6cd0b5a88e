"""Round trips and edge cases of the file formats."""

import gzip
import math
import struct
import zlib

import numpy as np
import pytest

from karst.functions import special
from karst.operators import pca, scaling
from karst.sources import bgen as bgen_source
from karst.sources import genotypes, matrices, sinks


def test_bed_round_trip(spark, tmp_path):
    # five samples: the last byte of a row is padded; a missing and a monomorphic feature
    x = np.array([[0, 1, 2, -1, 1], [-1] * 5, [2] * 5, [0, 0, 1, 2, 2]])
    assert (genotypes.decode_bed(genotypes.encode_bed(x), 5) == x).all()
    prefix = str(tmp_path / "a")
    rows = spark.createDataFrame([(i, [None if v < 0 else int(v) for v in r]) for i, r in enumerate(x)], "feature_idx long, dos array<bigint>")
    sinks.write_bed(rows, prefix + ".bed")
    (tmp_path / "a.fam").write_text("".join(f"f{i} i{i} 0 0 0 -9\n" for i in range(5)))
    (tmp_path / "a.bim").write_text("".join(f"1\trs{i}\t0\t{i + 1}\tA\tG\n" for i in range(4)))
    dosage, sites, people = genotypes.read_plink(spark, prefix)
    got = np.array([[-1 if v is None else v for v in r["dos"]] for r in dosage.orderBy("feature_idx").collect()])
    assert (got == x).all() and people.count() == 5 and sites.orderBy("feature_idx").first()["snp_id"] == "rs0"
    genotypes.check_bim(sites, sites)
    (tmp_path / "a.bed").write_bytes(b"xyz")
    with pytest.raises(Exception, match="bed"):
        genotypes.read_plink(spark, prefix)[0].collect()


def bgen(tmp_path, probs, bits, compression):
    m, n, _ = probs.shape
    out = struct.pack("<IIII", 20, 20, m, n) + b"bgen" + struct.pack("<I", compression | 2 << 2)
    for j in range(m):
        out += b"".join(struct.pack("<H", len(t)) + t for t in (b"v", b"rs%d" % j, b"1"))
        out += struct.pack("<IH", 100 + j, 2) + struct.pack("<I", 1) + b"A" + struct.pack("<I", 1) + b"G"
        gone = np.isnan(probs[j, :, 0])
        q = np.rint(np.nan_to_num(probs[j, :, :2]) * (2**bits - 1)).astype(int).ravel()
        raw = np.packbits(((q[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        body = struct.pack("<IHBB", n, 2, 2, 2) + bytes(2 | (128 if g else 0) for g in gone) + bytes([0, bits]) + raw
        if compression:
            import zstandard

            packed = zlib.compress(body) if compression == 1 else zstandard.compress(body)
            out += struct.pack("<II", len(packed) + 4, len(body)) + packed
        else:
            out += struct.pack("<I", len(body)) + body
    path = str(tmp_path / f"t{bits}_{compression}.bgen")
    open(path, "wb").write(out)
    return path


@pytest.mark.parametrize("bits,compression", [(8, 1), (16, 2), (11, 0)])
def test_bgen(spark, tmp_path, bits, compression):
    rng = np.random.default_rng(bits)
    p = rng.dirichlet([2, 1, 1], (3, 5))
    p[1, 2] = np.nan
    rows = bgen_source.read_bgen(spark, bgen(tmp_path, p, bits, compression)).orderBy("feature_idx").collect()
    assert [r["snp_id"] for r in rows] == ["rs0", "rs1", "rs2"] and rows[2]["bp"] == 102
    assert rows[1]["p0"][2] is None
    assert np.allclose(rows[0]["p0"], p[0, :, 0], atol=2 / 2**bits)
    dose = 2 * p[0, :, 0] + p[0, :, 1]
    assert np.allclose(rows[0]["dosage"], dose if dose.mean() <= 1 else 2 - dose, atol=6 / 2**bits)


def test_beagle(spark, tmp_path):
    path = str(tmp_path / "x.beagle.gz")
    with gzip.open(path, "wt") as f:
        f.write("marker\tallele1\tallele2\ta\ta\ta\tb\tb\tb\n1_10\t0\t2\t0.9\t0.05\t0.05\t0.1\t0.8\t0.1\n1_20\t1\t3\t0.2\t0.3\t0.5\t1\t0\t0\n")
    gl, markers, names = genotypes.read_beagle(spark, path)
    got = {r["feature_idx"]: (r["p0"], r["p1"]) for r in gl.collect()}
    assert got == {0: ([0.9, 0.1], [0.05, 0.8]), 1: ([0.2, 1.0], [0.3, 0.0])}
    assert [r["iid"] for r in names.orderBy("sample_idx").collect()] == ["a", "b"]
    assert markers.filter("feature_idx = 1").first()["a2"] == "3"


def test_csv_zst_and_bin(spark, tmp_path):
    import zstandard

    path = str(tmp_path / "m.csv.zst")
    open(path, "wb").write(zstandard.compress(b"1,0,3\n0,2,5\n"))
    assert matrices.is_zstd(path)
    rows = matrices.read_csv_matrix(spark, path)
    assert [r["values"] for r in rows.orderBy("feature_idx").collect()] == [[1, 0, 3], [0, 2, 5]]
    assert matrices.csv_cells(rows).count() == 4
    ragged = tmp_path / "r.csv"
    ragged.write_text("1,2\n3\n")
    with pytest.raises(ValueError):
        matrices.read_csv_matrix(spark, str(ragged))
    out = str(tmp_path / "m.bin")
    sinks.write_matrix(rows, 3, out)
    got = [r["values"] for r in matrices.read_bin(spark, out).orderBy("feature_idx").collect()]
    assert np.allclose(got, np.array([[1, 0, 3], [0, 2, 5]]) - np.array([[4 / 3], [7 / 3]]), atol=1e-6)


def test_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((9, 4))
    rows = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "feature_idx long, values array<double>")
    fit = pca.full(rows, 3)
    prefix = str(tmp_path / "model")
    sinks.write_eigs(spark, fit, prefix, loadings=True)
    sites = spark.createDataFrame([(i, "1", f"rs{i}", i, "A", "G") for i in range(9)], "feature_idx long, chr string, snp_id string, bp long, a1 string, a2 string")
    af = spark.createDataFrame([(i, i / 10) for i in range(9)], "feature_idx long, af double")
    sinks.write_sites(sites, af, prefix + ".mbim")
    got = matrices.read_model(spark, prefix)
    assert (got["n"], got["m"]) == (4, 9) and np.allclose(got["s"], fit.s, rtol=1e-5)
    u = np.array([r["pcs"] for r in got["u"].orderBy("sample_idx").collect()])
    assert np.allclose(u, fit.u, atol=1e-5)
    assert np.allclose(matrices.read_eigvals(spark, prefix + ".eigvals"), fit.s**2 / 9 * 2, rtol=1e-5)
    assert [r["af"] for r in got["af"].orderBy("feature_idx").collect()] == [i / 10 for i in range(9)]
    with pytest.raises(ValueError):
        matrices.read_table(spark, prefix + ".eigvecs", "sample_idx", 2)


def test_lines_of_unequal_part_files_keep_their_order(spark, tmp_path):
    """Spark reads large files first, and files in splits; lines are numbered by file and place all the same."""
    folder = tmp_path / "m.loadings"
    folder.mkdir()
    want = []
    for i, n in enumerate([1, 5, 2, 4000, 1, 3]):
        own = [f"{i}.{j}\t{j}" for j in range(n)]
        (folder / f"part-{i:05d}.txt").write_text("\n".join(own) + "\n")
        want += [[float(x) for x in line.split("\t")] for line in own]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = matrices.read_table(spark, str(folder), "feature_idx", 2).orderBy("feature_idx").collect()
        assert [r["feature_idx"] for r in rows] == list(range(len(want))) and [r["pcs"] for r in rows] == want
        sites = tmp_path / "m.mbim"
        sites.mkdir()
        lines = [f"1\trs{i}\t0\t{i}\tA\tG\t{i / 1000}" for i in range(60)]
        for k, (a, b) in enumerate([(0, 2), (2, 50), (50, 60)]):
            (sites / f"part-{k:05d}.csv").write_text("\n".join(lines[a:b]) + "\n")
        got = genotypes.read_bim(spark, str(sites)).orderBy("feature_idx").collect()
        assert [r["line"] for r in got] == lines
        assert [r["af"] for r in matrices.read_frequencies(spark, str(sites)).orderBy("feature_idx").collect()] == [i / 1000 for i in range(60)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_count_matrices_keep_empty_rows_and_columns(spark, tmp_path):
    (tmp_path / "z.csv").write_text("0,0,0\n1,0,2\n0,0,0\n3,0,1\n")
    raw = matrices.read_csv_matrix(spark, str(tmp_path / "z.csv"))
    features, samples = matrices.csv_axes(raw)
    for method in (1, 2, 3, 4):
        got = scaling.scaled(matrices.csv_cells(raw), samples, method, features=features).collect()
        assert {(r["feature_idx"], r["sample_idx"]) for r in got} == {(i, j) for i in range(4) for j in range(3)}
        assert all(r["x"] == 0 for r in got if r["feature_idx"] in (0, 2))


def test_chi_square_tail(spark):
    xs = [0.0, 1e-8, 0.3, 1.0, 3.84, 6.2, 12.4, 12.6, 50.0, 700.0, -1.0, float("nan"), None]
    got = [r[1] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select("x", special.chi_square_tail("x")).collect()]
    want = [1.0 if x is None or x != x or x < 0 else math.erfc(math.sqrt(x / 2)) for x in xs]
    assert np.allclose(got, want, rtol=1e-11, atol=1e-15)


def test_reports(spark, tmp_path):
    rep = spark.createDataFrame([("1", 1, "a", "1", 2, "b", 0.25)], "chr_a string, bp_a long, snp_a string, chr_b string, bp_b long, snp_b string, r2 double")
    sinks.write_r2(rep, str(tmp_path / "x.ld.gz"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "x.ld.gz")).first()["R2"] == "0.250000"
    (tmp_path / "a.assoc").write_text("CHR\tBP\tP\tX\n1\t5\t0.01\tq\n")
    assert matrices.read_assoc(spark, str(tmp_path / "a.assoc")).first()["line"] == "1\t5\t0.01\tq"
    with pytest.raises(ValueError):
        matrices.read_assoc(spark, str(tmp_path / "a.assoc"), ("CHR", "POS", "P"))


def test_special_functions():
    assert special.gamma_p(0.5, 2) == pytest.approx(1 - special.erfc(2**0.5), abs=1e-12)
    assert special.gamma_q(3, 9) == pytest.approx(np.exp(-9) * (1 + 9 + 40.5), rel=1e-10)
    assert special.beta_i(2, 3, 0.3) == pytest.approx(0.3483, abs=1e-6)
    own, left, right, two = special.fisher_exact(3, 1, 1, 3)
    assert two == pytest.approx(0.4857142857) and left + right - own == pytest.approx(1)
