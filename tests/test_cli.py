"""The command line end to end on a small PLINK set."""

import numpy as np
import pytest

from karst import cli
from karst.sources import matrices, sinks


@pytest.fixture(scope="module")
def plink(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("plink")
    rng = np.random.default_rng(0)
    x = rng.binomial(2, rng.uniform(0.2, 0.8, (60, 1)), (60, 13))
    x[3, 4] = -1
    rows = spark.createDataFrame([(i, [None if v < 0 else int(v) for v in r]) for i, r in enumerate(x)], "feature_idx long, dos array<bigint>")
    sinks.write_bed(rows, str(d / "a.bed"))
    (d / "a.fam").write_text("".join(f"f{i} i{i} 0 0 0 -9\n" for i in range(13)))
    (d / "a.bim").write_text("".join(f"{1 + i // 30}\trs{i}\t0\t{100 * (i % 30) + 1}\tA\tG\n" for i in range(60)))
    return str(d / "a"), d


def test_pca_ld_hwe_and_projection(spark, plink):
    prefix, d = plink
    out = str(d / "m")
    cli.main(["-b", prefix, "-k", "2", "-d", "1", "-V", "-D", "-o", out])
    n, m, s = matrices.read_sigvals(spark, out + ".sigvals")
    assert (n, m, len(s)) == (13, 60, 2)
    log = (d / "m.log").read_text()
    assert "pc=2" in log and "13 samples, 60 features" in log and "total wall time" in log
    assert spark.read.text(out + ".eigvecs2").count() == 14
    cli.main(["-B", out + ".residuals", "-f", out + ".mbim", "--ld-r2", "0.3", "--ld-bp", "500", "-o", out])
    kept, gone = (sorted(r["value"] for r in spark.read.text(f"{out}.ld.prune.{x}").collect()) for x in ("in", "out"))
    assert sorted(kept + gone) == sorted(r["value"] for r in spark.read.text(out + ".mbim").collect()) and len(kept[0].split("\t")) == 7
    cli.main(["-B", out + ".residuals", "-f", out + ".mbim", "-R", "--ld-bp", "500", "-o", out])
    assert spark.read.option("header", True).option("sep", "\t").csv(out + ".ld.gz").columns[-1] == "R2"
    (d / "p.assoc").write_text("CHR\tBP\tP\n" + "".join(f"{1 + i // 30}\t{100 * (i % 30) + 1}\t{(i + 1) / 100}\n" for i in range(60)))
    cli.main(["-B", out + ".residuals", "-f", out + ".mbim", "--clump", str(d / "p.assoc"), "--clump-p1", "0.2", "--clump-p2", "0.5", "--clump-r2", "0.1", "--clump-bp", "500", "-o", out])
    clumps = [r["value"] for r in spark.read.text(out + ".p0.clump").collect()]
    assert "CHR\tBP\tP\tSP2" in clumps and len(clumps) > 1 and all(len(x.split("\t")) == 4 for x in clumps)
    cli.main(["-b", prefix, "--USV", out, "--project", "2", "-o", out + "p"])
    assert spark.read.text(out + "p.eigvecs2").count() == 14
    cli.main(["-b", prefix, "--USV", out, "--inbreed", "1", "--maxiter", "2", "-o", out])
    assert spark.read.option("header", True).option("sep", "\t").csv(out + ".hwe").count() == 60


def test_rejections():
    with pytest.raises(NotImplementedError):
        cli.main(["-b", "x", "--USV", "y", "--project", "3"])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--no-such-option"])


def test_likelihoods(spark, tmp_path):
    """The EM models, equilibrium tests and projection from BEAGLE likelihoods, and --maf with the model's own numbers."""
    rng = np.random.default_rng(3)
    x = rng.binomial(2, rng.uniform(0.2, 0.8, (40, 1)), (40, 9))
    gl = np.full((40, 9, 3), 0.05)
    np.put_along_axis(gl, x[:, :, None], 0.9, 2)
    head = "marker\tallele1\tallele2\t" + "\t".join(f"s{i}\ts{i}\ts{i}" for i in range(9))
    lines = ["\t".join([f"rs{i}", "A", "G", *(f"{v:.2f}" for v in gl[i].ravel())]) for i in range(40)]
    (tmp_path / "a.beagle").write_text("\n".join([head, *lines]) + "\n")
    rows = spark.createDataFrame([(i, [int(v) for v in 2 - r]) for i, r in enumerate(x)], "feature_idx long, dos array<bigint>")
    sinks.write_bed(rows, str(tmp_path / "a.bed"))
    (tmp_path / "a.fam").write_text("".join(f"f{i} i{i} 0 0 0 -9\n" for i in range(9)))
    (tmp_path / "a.bim").write_text("".join(f"1\trs{i}\t0\t{i + 1}\tA\tG\n" for i in range(40)))
    out = str(tmp_path / "m")
    cli.main(["-b", str(tmp_path / "a"), "-k", "2", "-d", "1", "-V", "--maf", "0.3", "-o", out])
    used = [r["value"].split("\t")[1] for r in spark.read.text(out + ".mbim").collect()]
    assert 0 < len(used) < 40
    cli.main(["-G", str(tmp_path / "a.beagle"), "--USV", out, "--inbreed", "1", "--maxiter", "3", "-o", out])
    ids = {r["#ID"] for r in spark.read.option("header", True).option("sep", "\t").csv(out + ".hwe").collect()}
    assert ids == set(used)
    cli.main(["-G", str(tmp_path / "a.beagle"), "--USV", out, "--project", "2", "--maxiter", "3", "-o", out + "p"])
    assert spark.read.text(out + "p.eigvecs2").count() == 10
    cli.main(["-G", str(tmp_path / "a.beagle"), "-k", "2", "-d", "1", "--maxiter", "2", "-o", out + "g"])
    assert spark.read.text(out + "g.cov").count() == 9
