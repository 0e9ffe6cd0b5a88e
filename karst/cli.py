"""Command line: PCA, LD, equilibrium tests and projection on files, by the options users know.

Example: python -m karst.cli -b data/plink -k 10 -d 2 -o out
"""

from __future__ import annotations

import argparse
import logging
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.operators import em, frequency, hwe, ld, matrix, pca, project, scaling, tiles
from karst.params import PcaParams
from karst.sources import bgen, genotypes, matrices, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("karst", description=__doc__)
    p.add_argument("-m", "--memory", type=float, default=0, help="above 0, -b with -d 2 also writes the permuted copy out.perm.bed, .bim and .fam; Spark needs no limit")
    p.add_argument("-n", "--threads", type=int, default=12, help="ignored: see the Spark configuration")
    p.add_argument("-v", "--verbose", type=int, default=1)
    p.add_argument("-d", "--svd", type=int, default=2, help="0 Lanczos, 1 randomised, 2 windowed, 3 full")
    p.add_argument("-k", "--pc", type=int, default=10)
    p.add_argument("-C", "--scale", type=int, default=None, choices=range(5))
    p.add_argument("-p", "--maxp", type=int, default=20)
    p.add_argument("-S", "--no-shuffle", action="store_true")
    p.add_argument("-w", "--batches", type=int, default=8)
    p.add_argument("--seed", type=int, default=101)
    p.add_argument("--emu", action="store_true")
    p.add_argument("--pcangsd", action="store_true")
    p.add_argument("--M", type=int, default=0)
    p.add_argument("--N", type=int, default=0)
    p.add_argument("--scale-factor", type=float, default=1.0)
    p.add_argument("--buffer", type=int, default=2, help="ignored")
    p.add_argument("--imaxiter", type=int, default=1000)
    p.add_argument("--itol", type=float, default=1e-6)
    p.add_argument("--ncv", type=int, default=0)
    p.add_argument("--oversamples", type=int, default=0)
    p.add_argument("--rand", type=int, default=1)
    p.add_argument("--maxiter", type=int, default=100)
    p.add_argument("--tol-rsvd", type=float, default=1e-4)
    p.add_argument("--tol-em", type=float, default=1e-5)
    p.add_argument("--tol-maf", type=float, default=1e-6)
    p.add_argument("-b", "--bfile")
    p.add_argument("--haploid", action="store_true")
    p.add_argument("-B", "--binary")
    p.add_argument("-c", "--csv")
    p.add_argument("-g", "--bgen")
    p.add_argument("-G", "--beagle")
    p.add_argument("-f", "--match-bim")
    p.add_argument("--USV")
    p.add_argument("-o", "--out", default="karst")
    p.add_argument("-V", "--printv", action="store_true")
    p.add_argument("-D", "--ld", action="store_true")
    p.add_argument("-R", "--print-r2", action="store_true")
    p.add_argument("--maf", type=float, default=0.0)
    p.add_argument("--project", type=int, default=0)
    p.add_argument("--inbreed", type=int, default=0)
    p.add_argument("--ld-r2", type=float, default=0.0)
    p.add_argument("--ld-bp", type=int, default=0)
    p.add_argument("--ld-stats", type=int, default=0)
    p.add_argument("--clump")
    p.add_argument("--clump-names", default="CHR,BP,P")
    p.add_argument("--clump-p1", type=float, default=1e-4)
    p.add_argument("--clump-p2", type=float, default=0.01)
    p.add_argument("--clump-r2", type=float, default=0.5)
    p.add_argument("--clump-bp", type=int, default=250_000)
    return p


def params(a: argparse.Namespace) -> PcaParams:
    return PcaParams(
        k=a.pc, method=a.svd, scale=a.scale, max_power=a.maxp, windows=a.batches, shuffle=not a.no_shuffle, seed=a.seed,
        em="emu" if a.emu else "pcangsd" if a.pcangsd or a.beagle else None, oversamples=a.oversamples,
        omega="gaussian" if a.rand == 1 else "uniform", max_iter=a.maxiter, tol_rsvd=a.tol_rsvd, tol_em=a.tol_em, tol_maf=a.tol_maf,
        lanczos_iter=a.imaxiter, lanczos_tol=a.itol, ncv=a.ncv, maf=a.maf, ploidy=1 if a.haploid else 2, scale_factor=a.scale_factor,
    )


def _bgen(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, sites and samples of a BGEN file; samples are named by their number."""
    rows = bgen.read_bgen(spark, path)
    n = (rows.select(F.size("dosage").alias("n")).first() or [0])[0]
    people = spark.range(n).select(F.col("id").alias("sample_idx"), F.concat(F.lit("S"), "id").alias("iid"))
    return rows, rows.select("feature_idx", "chr", "snp_id", "bp", "a1", "a2"), people


def load_dosage(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dosages (feature_idx, dos: an array over samples), sites and samples of -b or -g."""
    if a.bfile:
        return genotypes.read_plink(spark, a.bfile)
    rows, sites, people = _bgen(spark, a.bgen)
    return rows.select("feature_idx", F.col("dosage").alias("dos")), sites, people


def load_likelihoods(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Likelihoods (feature_idx, p0, p1: arrays over samples), sites or markers, and samples of -G, -g or -b."""
    if a.beagle:
        return genotypes.read_beagle(spark, a.beagle)
    if a.bgen:
        rows, sites, people = _bgen(spark, a.bgen)
        return bgen.bgen_likelihoods(rows), sites, people
    rows, sites, people = genotypes.read_plink(spark, a.bfile)
    return frequency.call_likelihood_rows(rows), sites, people


def run_pca(spark: SparkSession, a: argparse.Namespace) -> None:
    p = params(a)
    sites = people = None
    af = None
    if a.binary:
        rows = matrices.read_bin(spark, a.binary)
    elif a.csv:
        raw = matrices.read_csv_matrix(spark, a.csv)
        rows = scaling.scaled_rows(raw, pca.shape(raw)[1], p.scale or 0, p.scale_factor)
    elif a.beagle or p.em == "pcangsd":
        gl, sites, people = load_likelihoods(spark, a)
        af = frequency.em_maf_rows(gl, p.max_iter, p.tol_maf)
        if p.maf > 0:
            af = frequency.filter_maf(af, p.maf).select("feature_idx", "af")
        _, cov, _ = em.pcangsd(gl.join(af, "feature_idx"), p)
        sinks.write_covariance(cov, a.out + ".cov")
        # all vectors of a small covariance, the leading ones of a large one
        _, u = cov.leading(cov.n if cov.n <= tiles.SMALL else p.k)
        sinks.write_eigvecs2(spark, people, u * matrix.flip_signs(u), a.out + ".eigvecs2")
        return
    else:
        dosage, sites, people = load_dosage(spark, a)
        if a.memory > 0 and a.bfile and p.method == "winsvd" and p.shuffle:
            sinks.write_permuted(dosage, sites, people, a.out, p.windows)
        known = frequency.frequency_rows(dosage)
        if p.maf > 0:
            known = known.filter(frequency.maf(F.col("af")) > p.maf)
        af = known.select("feature_idx", "af")
        if p.em == "emu":
            fit, _ = em.emu(em.seen_rows(known), p)
            return save(spark, a, p, fit, people, sites, af)
        rows = frequency.genotype_rows(known, not (p.scale == 0 or a.ld), p.ploidy)
    fit = pca.pca(rows, p)
    save(spark, a, p, fit, people, sites, af)
    if a.ld:
        out = rows if a.ld_stats else ld.residual_rows(rows, fit.u)
        sinks.write_matrix(out, len(fit.u), a.out + ".residuals")


def save(spark: SparkSession, a: argparse.Namespace, p: PcaParams, fit: pca.Pca, people: DataFrame | None, sites: DataFrame | None, af: DataFrame | None) -> None:
    logging.getLogger("karst").info("%d samples, %d features, %d passes; singular values %s", len(fit.u), fit.n_features, fit.passes, fit.s)
    sinks.write_eigs(spark, fit, a.out, p.ploidy, a.printv)
    if people is not None:
        sinks.write_eigvecs2(spark, people, fit.u, a.out + ".eigvecs2")
    if sites is not None and af is not None and (a.printv or a.ld):
        sinks.write_sites(sites, af, a.out + ".mbim")


def run_ld(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.binary:
        rows = matrices.read_bin(spark, a.binary)
        sites = genotypes.read_bim(spark, a.match_bim)
    else:
        dosage, sites, _ = genotypes.read_plink(spark, a.bfile)
        known = frequency.frequency_rows(dosage)
        rows, sites = frequency.genotype_rows(known, False), sites.drop("af").join(known.select("feature_idx", "af"), "feature_idx")
    if a.USV:
        u = np.array([r["pcs"] for r in matrices.read_table(spark, a.USV + ".eigvecs", "sample_idx").orderBy("sample_idx").collect()])
        rows = ld.residual_rows(rows, u)
    width = a.clump_bp if a.clump else a.ld_bp
    pairs = ld.r2_pairs(rows, sites, width)
    if a.clump:
        for i, path in enumerate(a.clump.split(",")):
            assoc = matrices.read_assoc(spark, path, tuple(a.clump_names.split(",")))
            ld.check_same_order(assoc, sites)
            got = ld.clump(pairs, sites, assoc, a.clump_p1, a.clump_p2, a.clump_r2, a.clump_bp)
            sinks.write_clumps(got, assoc, a.out, matrices.assoc_header(spark, path), i)
    elif a.print_r2:
        sinks.write_r2(ld.r2_report(pairs, sites), a.out + ".ld.gz")
    else:
        known = sites if sites.filter("af is null").isEmpty() else sites.drop("af")
        sinks.write_prune(sites, ld.prune(pairs, known, a.ld_r2), a.out)


def _model(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """u, v, s in long form, and af."""
    m = matrices.read_model(spark, prefix)
    long_ = lambda df, key, name: df.select(key, F.posexplode("pcs").alias("k", name)).withColumn("k", F.col("k").cast("long"))
    s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(m["s"])], "k long, s double")
    return long_(m["u"], "sample_idx", "u"), long_(m["v"], "feature_idx", "v"), s, m["af"]


def run_inbreeding(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sites of the file meet the model's by id, else by `chr_pos`; the model's own numbers count its sites only."""
    u, v, s, _ = _model(spark, a.USV)
    gl, sites, _ = load_likelihoods(spark, a)
    ref = genotypes.read_bim(spark, a.USV + ".mbim")
    by_id = project.first_of(ref.withColumnRenamed("feature_idx", "ref_idx"), "snp_id").select("snp_id", "ref_idx", "af")
    place = F.concat_ws("_", "chr", "bp")
    by_place = project.first_of(ref.withColumnRenamed("feature_idx", "ref_idx").withColumn("snp_id", place), "snp_id").select("snp_id", F.col("ref_idx").alias("r2"), F.col("af").alias("a2"))
    hit = sites.select("feature_idx", "snp_id").join(by_id, "snp_id", "left").join(by_place, "snp_id", "left")
    hit = hit.select("feature_idx", F.coalesce("ref_idx", "r2").alias("ref_idx"), F.coalesce("af", "a2").alias("af")).filter("ref_idx is not null")
    project.require_overlap(hit)
    w = hwe.loading_rows(v).select(F.col("feature_idx").alias("ref_idx"), "w")
    rows = gl.join(hit, "feature_idx").join(w, "ref_idx").select("feature_idx", "p0", "p1", "w", "af")
    _, us = hwe.score_matrix(u, s)
    sinks.write_hwe(hwe.inbreeding(hwe.with_frequencies(rows, us), a.maxiter).table, sites, a.out + ".hwe")


def run_project(spark: SparkSession, a: argparse.Namespace) -> None:
    _, v, s, af = _model(spark, a.USV)
    ref = genotypes.read_bim(spark, a.USV + ".mbim").drop("af").join(af, "feature_idx").withColumnRenamed("feature_idx", "ref_idx")
    if a.beagle:
        gl, markers, people = genotypes.read_beagle(spark, a.beagle)
        hit = project.require_overlap(project.match_markers(markers, ref))
        w, k = project.weights(project.matched_loadings(hit, v), s)
        u = project.project_likelihood_rows(gl, w, hit.select("feature_idx", "af"), people.count(), k, a.maxiter, a.tol_em)
    else:
        dosage, sites, people = load_dosage(spark, a)
        hit = project.require_overlap(project.match_sites(sites, ref))
        w, k = project.weights(project.matched_loadings(hit, v), s)
        rows = dosage.join(hit.select("feature_idx", "af"), "feature_idx").join(w, "feature_idx")
        rows = rows.select("feature_idx", F.transform("dos", lambda x: x / 2.0 - F.col("af")).alias("g"), "w")
        u = project.project_rows(a.project, rows, k, people.count(), np.array([r["s"] for r in s.orderBy("k").collect()]))
    sinks.write_eigvecs2(spark, people, u, a.out + ".eigvecs2")


def run_log(a: argparse.Namespace) -> logging.Logger:
    """The log of a run: prefix.log beside the results on this machine, and the terminal if --verbose is 1 or more."""
    log = logging.getLogger("karst")
    log.handlers.clear()
    log.setLevel(logging.DEBUG if a.verbose > 1 else logging.INFO)
    log.propagate = False
    if "://" not in a.out:
        log.addHandler(logging.FileHandler(a.out + ".log", mode="w"))
    if a.verbose > 0:
        log.addHandler(logging.StreamHandler())
    for h in log.handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
    return log


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.project > 2:
        raise NotImplementedError("projection method 3")
    spark = SparkSession.builder.appName("karst").getOrCreate()
    log, start = run_log(a), time.time()
    log.info("options: %s", ", ".join(f"{k}={v}" for k, v in sorted(vars(a).items()) if v not in (None, False)))
    run_command(spark, a)
    log.info("total wall time: %.1f seconds", time.time() - start)


def run_command(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.inbreed:
        run_inbreeding(spark, a)
    elif a.ld_r2 > 0 or a.print_r2 or a.clump:
        run_ld(spark, a)
    elif a.project:
        run_project(spark, a)
    else:
        run_pca(spark, a)


if __name__ == "__main__":
    main()
