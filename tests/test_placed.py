"""Files written by many tasks, and running sums and windows over ranges."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.operators import prefix
from karst.sources import genotypes, matrices, placed, sinks


def pieces(spark, chunks, parts):
    rows, at = [], 0
    for c in chunks:
        rows.append((at, c))
        at += len(c)
    return spark.createDataFrame(rows, placed.SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_file_equals_a_plain_one(spark, tmp_path, parts, monkeypatch):
    rng = np.random.default_rng(parts)
    chunks = [rng.bytes(int(n)) for n in rng.integers(1, 5000, 200)]
    path = tmp_path / "a.bin"
    path.write_bytes(b"what was there before")
    placed.write_placed(pieces(spark, chunks, parts), str(path))
    assert path.read_bytes() == b"".join(chunks)
    assert [x.name for x in tmp_path.iterdir()] == ["a.bin"]


def test_gaps_and_overlaps_leave_the_old_file(spark, tmp_path):
    path = tmp_path / "a.bin"
    path.write_bytes(b"old")
    good = pieces(spark, [b"abc", b"defg", b"hi", b"jkl"], 2)
    for bad in (good.filter("offset <> 3"), good.filter("offset > 0"), good.union(good.filter("offset = 7")), good.withColumn("offset", F.col("offset") + (F.col("offset") > 4).cast("int"))):
        with pytest.raises(Exception, match="overlap or leave out"):
            placed.write_placed(bad, str(path))
        assert path.read_bytes() == b"old" and len(list(tmp_path.iterdir())) == 1
    placed.write_placed(good.limit(0), str(path))
    assert path.read_bytes() == b""
    with pytest.raises(ValueError, match="mounted"):
        placed.write_placed(good, "s3://bucket/x")


@pytest.mark.parametrize("keep", ["true", "feature_idx % 3 <> 1"])
def test_residuals_file(spark, tmp_path, keep):
    x = np.random.default_rng(2).standard_normal((500, 7))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "feature_idx long, values array<double>")
    path = str(tmp_path / "a.residuals")
    sinks.write_matrix(rows.filter(keep).repartition(5), 7, path)
    own = x if keep == "true" else x[np.arange(500) % 3 != 1]
    assert open(path, "rb").read() == struct.pack("<II", *own.shape) + own.astype("<f4").tobytes()
    assert matrices.read_bin(spark, path).count() == len(own)


@pytest.mark.parametrize("m,bands", [(61, 8), (64, 8), (5, 8)])
def test_permuted_copy(spark, tmp_path, m, bands):
    rng = np.random.default_rng(m)
    x = rng.integers(-1, 3, (m, 10))
    rows = spark.createDataFrame([(i, [None if v < 0 else int(v) for v in r]) for i, r in enumerate(x)], "feature_idx long, dos array<bigint>").repartition(4)
    source = str(tmp_path / "a")
    sinks.write_bed(rows, source + ".bed")
    assert open(source + ".bed", "rb").read() == genotypes.BED_MAGIC + genotypes.encode_bed(x)
    bim = [f"{1 + i % 3}\trs{'x' * (i % 7)}é{i}\t0\t{i + 1}\tA\tG" for i in range(m)]
    fam = [f"f{i} i{i} 0 0 {i % 2} -9" for i in range(10)]
    (tmp_path / "a.bim").write_text("\n".join(bim) + "\n")
    (tmp_path / "a.fam").write_text("\n".join(fam) + "\n")
    out = str(tmp_path / "b")
    got = sinks.write_permuted(*genotypes.read_plink(spark, source), out, bands)
    order = sorted(range(m), key=lambda i: (i % bands, i))
    assert [r["feature_idx"] for r in got.orderBy("new_pos").collect()] == order
    assert open(out + ".perm.bed", "rb").read() == genotypes.BED_MAGIC + genotypes.encode_bed(x[order])
    assert open(out + ".perm.bim").read() == "".join(bim[i] + "\n" for i in order)
    assert open(out + ".perm.fam").read() == "\n".join(fam) + "\n"
    again, sites, _ = genotypes.read_plink(spark, out + ".perm")
    assert again.count() == sites.count() == m


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_and_windowed(spark, block):
    rng = np.random.default_rng(block)
    rows = [(str(g), int(i), None if i % 11 == 3 else float(v)) for g in "ab" for i, v in zip(rng.permutation(200), rng.standard_normal(200))]
    rows += [(None, 5, 1.0), (None, 2, 7.0)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(6)
    told = prefix.running(df, ["i"], {"before": F.col("v")}, ["g"])
    got = prefix.windowed(told, "rank", 4, 3, {"top": F.max("v"), "n": F.count(F.lit(1))}, ["g"], block).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for k, r in enumerate(sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])):
            near = own[max(0, k - 4) : k + 4]
            assert (r["rank"], r["i"], r["n"]) == (k, own[k][1], len(near))
            assert r["before"] == pytest.approx(sum(x[2] or 0 for x in own[:k]))
            assert r["top"] == max(x[2] for x in near if x[2] is not None)
    assert prefix.running(df.limit(0), ["i"]).count() == 0
