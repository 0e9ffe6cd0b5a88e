"""Queries over the derived inputs, one per operator, each with its SQL where SQL can say it.

Every number that comes of a float sum is rounded to six digits in both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst import fixtures as fx
from karst.fixtures import r6, sql_r6, with_views
from karst.functions import special
from karst.operators import em, frequency, hwe, ld, ldstats, matrix, pca, permute, prefix, project, scaling, tiles
from karst.params import PcaParams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LD_BP = 5000
R2_CUT = 0.2
CLUMP = {"p1": 0.05, "p2": 0.5, "r2": 0.1, "clump_bp": 5000}
#: Distance bins that the derived sites fill.
SITE_BINS = (1000, 2000, 3000, 4000, 5000)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- frequencies -------------------------------------------------------------------------------


def _af(spark: SparkSession, d: str) -> DataFrame:
    return frequency.allele_frequency(fx.dosage(spark, d))


@query("af_est", with_views("fx_af") + "SELECT feature_idx, n, n_missing, round(af, 6) AS af FROM fx_af")
def af_est(spark, d):
    return _af(spark, d).select("feature_idx", "n", "n_missing", F.round("af", 6).alias("af"))


@query("missing_share", with_views("fx_dosage") + "SELECT round((count(*) - count(dos))::DOUBLE / count(*), 6) AS p_missing FROM fx_dosage")
def missing_share(spark, d):
    return frequency.missing_share(fx.dosage(spark, d)).select(F.round("p_missing", 6).alias("p_missing"))


@query(
    "maf_filter",
    with_views("fx_af")
    + "SELECT feature_idx, row_number() OVER (ORDER BY feature_idx) - 1 AS new_idx, round(maf, 6) AS maf FROM"
    " (SELECT feature_idx, CASE WHEN af > 0.5 THEN 1 - af ELSE af END AS maf FROM fx_af) WHERE maf > 0.2::DOUBLE",
)
def maf_filter(spark, d):
    return frequency.filter_maf(_af(spark, d), 0.2).select("feature_idx", "new_idx", F.round("maf", 6).alias("maf"))


_CENTRED = "g0 AS (SELECT feature_idx, sample_idx, af, coalesce(dos / 2.0::DOUBLE - af, 0) AS g FROM fx_dosage JOIN fx_af USING (feature_idx))"


@query("center_geno", with_views("fx_af", more=_CENTRED) + f"SELECT feature_idx, sample_idx, {sql_r6('g')} AS g FROM g0")
def center_geno(spark, d):
    return frequency.centred(fx.dosage(spark, d), _af(spark, d)).select("feature_idx", "sample_idx", r6(F.col("g")).alias("g"))


@query(
    "standardize_geno",
    with_views("fx_af", more=_CENTRED)
    + "SELECT feature_idx, sample_idx, "
    + sql_r6("CASE WHEN sqrt(2 * af * (1 - af)) > 1e-9 THEN g / sqrt(2 * af * (1 - af)) ELSE g END")
    + " AS g FROM g0",
)
def standardize_geno(spark, d):
    return frequency.standardised(fx.dosage(spark, d), _af(spark, d)).select("feature_idx", "sample_idx", r6(F.col("g")).alias("g"))


@query(
    "geno_to_gl",
    with_views("fx_dosage")
    + "SELECT feature_idx, sample_idx, CASE WHEN dos IS NULL THEN 0.333333::DOUBLE WHEN dos = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p0,"
    " CASE WHEN dos IS NULL THEN 0.333333::DOUBLE WHEN dos = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p1 FROM fx_dosage",
)
def geno_to_gl(spark, d):
    return frequency.calls_to_likelihoods(fx.dosage(spark, d))


_W = "w AS (SELECT feature_idx, sample_idx, af, p0 * (1 - af) * (1 - af) AS w0, p1 * 2.0::DOUBLE * af * (1 - af) AS w1, (1 - p0 - p1) * af * af AS w2 FROM fx_gl JOIN fx_af USING (feature_idx))"


@query("gl_dosage", with_views("fx_gl", "fx_af", more=_W) + f"SELECT feature_idx, sample_idx, {sql_r6('(w1 + 2 * w2) / (w0 + w1 + w2) - 2 * af')} AS e FROM w")
def gl_dosage(spark, d):
    return frequency.expected_dosage(fx.likelihoods(spark, d), _af(spark, d)).select("feature_idx", "sample_idx", r6(F.col("e")).alias("e"))


def _em_maf_sql(steps: int) -> str:
    parts = ["e0 AS (SELECT DISTINCT feature_idx, 0.25::DOUBLE AS af FROM fx_gl)"]
    for i in range(steps):
        parts.append(
            f"e{i + 1} AS (SELECT feature_idx, avg((w1 + 2 * w2) / (2 * (w0 + w1 + w2))) AS af FROM (SELECT feature_idx,"
            f" p0 * (1 - af) * (1 - af) AS w0, p1 * 2.0::DOUBLE * af * (1 - af) AS w1, (1 - p0 - p1) * af * af AS w2 FROM fx_gl JOIN e{i} USING (feature_idx))"
            " GROUP BY feature_idx)"
        )
    return with_views("fx_gl", more=",\n".join(parts)) + f"SELECT feature_idx, round(af, 6) AS af FROM e{steps}"


@query("em_maf_5", _em_maf_sql(5))
def em_maf_5(spark, d):
    return frequency.em_maf(fx.likelihoods(spark, d), steps=5).select("feature_idx", F.round("af", 6).alias("af"))


#: Steps until the root mean square change of one falls below 1e-6, 100 at most.
_EM_MAF = (
    "it(i, feature_idx, af, old) AS (SELECT 0, feature_idx, 0.25::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT feature_idx FROM fx_gl) UNION ALL"
    " SELECT any_value(i) + 1, feature_idx, avg((w1 + 2 * w2) / (2 * (w0 + w1 + w2))), any_value(af) FROM (SELECT it.*, p0 * (1 - af) * (1 - af) AS w0,"
    " p1 * 2.0::DOUBLE * af * (1 - af) AS w1, (1 - p0 - p1) * af * af AS w2 FROM it JOIN fx_gl USING (feature_idx)"
    " WHERE i < 100 AND (SELECT sqrt(avg((af - old) * (af - old))) FROM it) >= 1e-6::DOUBLE) GROUP BY feature_idx)"
)


@query("em_maf", with_views("fx_gl", recursive=True, more=_EM_MAF) + "SELECT feature_idx, round(af, 6) AS af FROM it WHERE i = (SELECT max(i) FROM it)")
def em_maf(spark, d):
    return frequency.em_maf_rows(fx.likelihood_rows(spark, d)).select("feature_idx", F.round("af", 6).alias("af"))


# --- counts ------------------------------------------------------------------------------------


_SIZES = "l AS (SELECT s.sample_idx, coalesce(sum(x), 0)::BIGINT AS libsize FROM fx_count_samples s LEFT JOIN fx_counts c ON c.sample_idx = s.sample_idx GROUP BY s.sample_idx), n AS (SELECT count(*) AS n, floor(median(libsize))::BIGINT AS med FROM l)"
_DENSE = (
    "f AS (SELECT feature_idx FROM fx_count_features), d AS (SELECT f.feature_idx, l.sample_idx, coalesce(t.x, 0) AS x FROM f CROSS JOIN l LEFT JOIN t"
    " ON t.feature_idx = f.feature_idx AND t.sample_idx = l.sample_idx), mo AS (SELECT feature_idx, avg(x) AS mean, stddev_samp(x) AS sd FROM d GROUP BY feature_idx)"
)


_COUNTS = ("fx_counts", "fx_count_features", "fx_count_samples")


def _scale_sql(expr: str) -> str:
    t = f"t AS (SELECT feature_idx, sample_idx, {expr} AS x FROM fx_counts JOIN l USING (sample_idx), n)"
    z = "CASE WHEN sd > 1e-10 THEN (x - mean) / sd ELSE x - mean END"
    return with_views(*_COUNTS, more=f"{_SIZES}, {t}, {_DENSE}") + f"SELECT feature_idx, sample_idx, {sql_r6(z)} AS x FROM d JOIN mo USING (feature_idx)"


@query("libsize_median", with_views("fx_counts", "fx_count_samples", more=_SIZES) + "SELECT n, med AS median_libsize FROM n")
def libsize_median(spark, d):
    return scaling.median_library_size(scaling.library_sizes(fx.counts(spark, d), fx.count_axes(spark, d)[1]))


def _scaled(method: int, factor: float = 1.0):
    def run(spark, d):
        features, samples = fx.count_axes(spark, d)
        return scaling.scaled(fx.counts(spark, d), samples, method, factor, features=features).select("feature_idx", "sample_idx", r6(F.col("x")).alias("x"))

    return run


query("scale_none", with_views("fx_counts") + "SELECT feature_idx, sample_idx, x::DOUBLE AS x FROM fx_counts")(_scaled(0))
query("scale_standard", _scale_sql("x::DOUBLE"))(_scaled(1))
query("scale_cpmed", _scale_sql("log10(x * (med / libsize) + 1)"))(_scaled(2))
query("scale_log1p", _scale_sql("ln(1 + x / libsize * 10000.0::DOUBLE)"))(_scaled(3, 10000.0))
query("scale_relative", _scale_sql("x / libsize * 10000.0::DOUBLE"))(_scaled(4, 10000.0))


# --- linkage disequilibrium --------------------------------------------------------------------


def _rows(spark, d) -> DataFrame:
    return frequency.genotype_rows(frequency.frequency_rows(fx.dosage_rows(spark, d)), False)


def _pairs(spark, d) -> DataFrame:
    return ld.r2_pairs(_rows(spark, d), fx.features(spark), LD_BP)


def _report(spark, d) -> DataFrame:
    return ld.r2_report(_pairs(spark, d), fx.features(spark))


_NORM = _CENTRED + ", nn AS (SELECT feature_idx, sqrt(sum(g * g)) AS nrm FROM g0 GROUP BY feature_idx)"
_LD = (
    _NORM
    + f", ip AS (SELECT a.feature_idx AS i, b.feature_idx AS k, a.chr AS chr, a.bp AS bp_i, b.bp AS bp_k, a.snp_id AS snp_i, b.snp_id AS snp_k FROM fx_features a JOIN fx_features b"
    f" ON a.chr = b.chr AND a.feature_idx < b.feature_idx AND b.bp - a.bp <= {LD_BP}),"
    " rr AS (SELECT i, k, any_value(chr) AS chr, any_value(bp_i) AS bp_i, any_value(bp_k) AS bp_k, any_value(snp_i) AS snp_i, any_value(snp_k) AS snp_k,"
    " sum(x.g * y.g) / (any_value(xn.nrm) * any_value(yn.nrm)) AS r FROM ip JOIN g0 x ON x.feature_idx = i JOIN g0 y ON y.feature_idx = k AND y.sample_idx = x.sample_idx"
    " JOIN nn xn ON xn.feature_idx = i JOIN nn yn ON yn.feature_idx = k GROUP BY i, k)"
)


def _ld_views(more: str = "", recursive: bool = False) -> str:
    return with_views("fx_af", "fx_features", "fx_assoc", recursive=recursive, more=_LD + (", " + more if more else ""))


# rows of `part` as sites: five chromosomes, positions that grow with the table
_SITES = (
    "sites AS (SELECT row_number() OVER (ORDER BY chr, bp, p_partkey) - 1 AS feature_idx, chr, bp"
    " FROM (SELECT p_partkey, (p_size % 5)::VARCHAR AS chr, p_partkey * 37 AS bp FROM part))"
)


def _sites(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") % 5).cast("string").alias("chr"), (F.col("p_partkey") * 37).alias("bp"))
    return prefix.running(rows, ["chr", "bp", "p_partkey"]).select(F.col("rank").alias("feature_idx"), "chr", "bp")


@query("chr_runs", f"WITH {_SITES} SELECT chr, min(feature_idx) AS first_idx, max(feature_idx) AS last_idx FROM sites GROUP BY chr")
def chr_runs(spark, d):
    return ld.chromosome_runs(_sites(spark, d))


@query(
    "ld_window",
    f"WITH {_SITES} SELECT a.feature_idx, count(*) AS n_sites FROM sites a JOIN sites b ON a.chr = b.chr AND b.feature_idx >= a.feature_idx AND b.bp - a.bp <= {LD_BP}"
    " WHERE a.feature_idx < (SELECT max(feature_idx) FROM sites c WHERE c.chr = a.chr) GROUP BY a.feature_idx",
)
def ld_window(spark, d):
    return ld.window_sizes(_sites(spark, d), LD_BP)


@query(
    "ld_band_pairs",
    f"WITH {_SITES} SELECT a.feature_idx AS i, b.feature_idx AS k, a.chr AS chr, a.bp AS bp_i, b.bp AS bp_k FROM sites a JOIN sites b"
    f" ON a.chr = b.chr AND a.feature_idx < b.feature_idx AND b.bp - a.bp <= {LD_BP}",
)
def ld_band_pairs(spark, d):
    return ld.band_pairs(_sites(spark, d), LD_BP)


@query(
    "ld_r2",
    _ld_views()
    + f"SELECT chr AS chr_a, bp_i AS bp_a, snp_i AS snp_a, chr AS chr_b, bp_k AS bp_b, snp_k AS snp_b, {sql_r6('r * r')} AS r2 FROM rr",
)
def ld_r2(spark, d):
    return _report(spark, d).withColumn("r2", r6(F.col("r2")))


@query("ld_dist", _ld_views() + f"SELECT chr, bp_k - bp_i AS distance, {sql_r6('sum(r * r)')} AS r2_total, count(*) AS n FROM rr GROUP BY chr, bp_k - bp_i")
def ld_dist(spark, d):
    return ldstats.by_distance(_report(spark, d)).withColumn("r2_total", r6(F.col("r2_total")))


_DECAY = (
    "nt AS (SELECT chr, r * r AS r2, ntile(8) OVER (PARTITION BY chr ORDER BY bp_k - bp_i, i, k) AS bin FROM rr),"
    f" dc AS (SELECT chr, bin * {LD_BP}.0::DOUBLE / 8 AS distance, count(*) AS num, avg(r2) AS avg_r2, stddev_samp(r2) AS std FROM nt GROUP BY chr, bin)"
)


def _decay(spark, d) -> DataFrame:
    return ldstats.decay(_report(spark, d), LD_BP, 8, ["bp_a", "bp_b"])


@query("ld_decay", _ld_views(_DECAY) + f"SELECT chr, distance, num, {sql_r6('avg_r2')} AS avg_r2, {sql_r6('std')} AS std FROM dc")
def ld_decay(spark, d):
    return _decay(spark, d).select("chr", "distance", "num", r6(F.col("avg_r2")).alias("avg_r2"), r6(F.col("std")).alias("std"))


_BIN = "CASE " + " ".join(f"WHEN bp_k - bp_i <= {b} THEN {b}" for b in SITE_BINS) + " END"


@query(
    "ld_bins",
    _ld_views()
    + f"SELECT bin, count(*) AS counts, {sql_r6('sum(r)')} AS r_sum, {sql_r6('sum(r * r)')} AS r2_sum FROM (SELECT {_BIN}::BIGINT AS bin, r FROM rr) WHERE bin IS NOT NULL GROUP BY bin",
)
def ld_bins(spark, d):
    products = ld.pair_products(ld.unit_rows(_rows(spark, d)), fx.features(spark), LD_BP)
    rows = ld.r2_report(products.withColumnRenamed("r", "r2"), fx.features(spark)).withColumnRenamed("r2", "r")
    got = ldstats.fixed_bins(rows, SITE_BINS)
    return got.select("bin", "counts", r6(F.col("r_sum")).alias("r_sum"), r6(F.col("r2_sum")).alias("r2_sum"))


@query("ld_weighted", _ld_views(_DECAY) + f"SELECT distance, {sql_r6('x - (1 - x) / 498.0::DOUBLE')} AS r2 FROM (SELECT distance, sum(avg_r2 * num) / sum(num) AS x FROM dc GROUP BY distance)")
def ld_weighted(spark, d):
    return ldstats.weighted(_decay(spark, d), 500).select("distance", r6(F.col("r2")).alias("r2"))


@query(
    "ld_cross",
    with_views("fx_af", "fx_features", more=_NORM)
    + "SELECT round(avg(r * r), 6) AS mean_r2 FROM (SELECT a.feature_idx, b.feature_idx, sum(x.g * y.g) / (any_value(xn.nrm) * any_value(yn.nrm)) AS r"
    " FROM fx_features a JOIN fx_features b ON a.chr = '1' AND b.chr = '2' JOIN g0 x ON x.feature_idx = a.feature_idx JOIN g0 y ON y.feature_idx = b.feature_idx"
    " AND y.sample_idx = x.sample_idx JOIN nn xn ON xn.feature_idx = a.feature_idx JOIN nn yn ON yn.feature_idx = b.feature_idx GROUP BY a.feature_idx, b.feature_idx)",
)
def ld_cross(spark, d):
    unit = ld.unit_rows(_rows(spark, d))
    return ldstats.cross_chromosome(unit, fx.features(spark), "1", "2").select(F.round("mean_r2", 6).alias("mean_r2"))


@query(
    "ld_prune",
    _ld_views(
        "mf AS (SELECT feature_idx, CASE WHEN af > 0.5 THEN 1 - af ELSE af END AS maf FROM fx_af),"
        f" el AS (SELECT i, list({{'k': k, 'hi': b.maf > a.maf}} ORDER BY k) AS es FROM rr JOIN mf a ON a.feature_idx = i JOIN mf b ON b.feature_idx = k WHERE r * r > {R2_CUT}::DOUBLE GROUP BY i),"
        " st(i, dropped) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL"
        " SELECT st.i + 1, CASE WHEN el.es IS NULL OR list_contains(st.dropped, st.i + 1) THEN st.dropped ELSE list_distinct(list_concat(st.dropped,"
        " list_transform(list_filter(el.es, lambda e: NOT list_contains(st.dropped, e.k)), lambda e: CASE WHEN e.hi THEN st.i + 1 ELSE e.k END))) END"
        " FROM st LEFT JOIN el ON el.i = st.i + 1 WHERE st.i < 63)",
        recursive=True,
    )
    + "SELECT feature_idx, NOT list_contains(dropped, feature_idx) AS keep FROM fx_features, st WHERE st.i = 63",
)
def ld_prune(spark, d):
    sites = fx.features(spark).join(_af(spark, d).select("feature_idx", "af"), "feature_idx")
    return ld.prune(_pairs(spark, d), sites, R2_CUT)


@query(
    "ld_clump",
    _ld_views(
        "hit AS (SELECT f.feature_idx, a.chr, a.bp, a.p FROM fx_assoc a JOIN fx_features f USING (chr, bp)"
        f" WHERE p <= {CLUMP['p2']}::DOUBLE QUALIFY row_number() OVER (PARTITION BY a.chr, a.bp ORDER BY row_idx) = 1),"
        " ed AS (SELECT i AS a, k AS b FROM rr WHERE r * r >= 0.1::DOUBLE UNION ALL SELECT k, i FROM rr WHERE r * r >= 0.1::DOUBLE),"
        " nb AS (SELECT a, list({'b': b, 'bp': h.bp} ORDER BY h.p, h.bp) AS ns FROM ed JOIN hit h ON h.feature_idx = b JOIN hit g ON g.feature_idx = a"
        f" WHERE abs(h.bp - g.bp) <= {CLUMP['clump_bp']} GROUP BY a),"
        f" ix AS (SELECT *, row_number() OVER (ORDER BY p, chr, bp) AS rk FROM hit WHERE p <= {CLUMP['p1']}::DOUBLE),"
        " st(rk, taken, feature_idx, got) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::STRUCT(b BIGINT, bp BIGINT)[] UNION ALL"
        " SELECT st.rk + 1, CASE WHEN list_contains(st.taken, ix.feature_idx) THEN st.taken ELSE list_concat(list_append(st.taken, ix.feature_idx),"
        " list_transform(list_filter(coalesce(nb.ns, []), lambda e: NOT list_contains(st.taken, e.b)), lambda e: e.b)) END,"
        " CASE WHEN list_contains(st.taken, ix.feature_idx) THEN NULL ELSE ix.feature_idx END,"
        " list_filter(coalesce(nb.ns, []), lambda e: NOT list_contains(st.taken, e.b)) FROM st JOIN ix ON ix.rk = st.rk + 1 LEFT JOIN nb ON nb.a = ix.feature_idx)",
        recursive=True,
    )
    + "SELECT h.chr, h.bp, round(h.p, 6) AS p, CASE WHEN len(got) = 0 THEN 'NONE' ELSE array_to_string(list_transform(got, lambda e: CAST(e.bp AS VARCHAR)), ',') END AS sp2"
    " FROM st JOIN hit h ON h.feature_idx = st.feature_idx",
)
def ld_clump(spark, d):
    got = ld.clump(_pairs(spark, d), fx.features(spark), fx.assoc(spark), CLUMP["p1"], CLUMP["p2"], CLUMP["r2"], CLUMP["clump_bp"])
    return got.withColumn("p", F.round("p", 6))


@query(
    "pval_map",
    "SELECT chr, bp, snp_id, round(p, 6) AS p FROM (SELECT o_orderkey AS row_idx, (o_custkey % 5)::VARCHAR AS chr, o_orderkey // 3 AS bp, 'rs' || o_orderkey AS snp_id,"
    " pow(((o_orderkey * 29 + 7) % 64 + 1) / 64.0::DOUBLE, 3) AS p FROM orders) WHERE p <= 0.01::DOUBLE QUALIFY row_number() OVER (PARTITION BY chr, bp ORDER BY row_idx) = 1",
)
def pval_map(spark, d):
    """Rows of `orders` as association rows, some of one place."""
    key = F.col("o_orderkey")
    p = F.pow(((key * 29 + 7) % 64 + 1) / 64.0, F.lit(3.0))
    chr_, bp = (F.col("o_custkey") % 5).cast("string"), F.floor(key / 3).cast("long")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        key.alias("row_idx"), chr_.alias("chr"), bp.alias("bp"), F.concat(F.lit("rs"), key.cast("string")).alias("snp_id"), p.alias("p")
    )
    return ld.first_per_site(rows, 0.01).select("chr", "bp", "snp_id", F.round("p", 6).alias("p"))


# --- models ------------------------------------------------------------------------------------


def _s(spark) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(fx.MODEL_S)], "k long, s double")


_FIT = "ft AS (SELECT feature_idx, sample_idx, sum(v * u * s) AS x FROM fx_v JOIN fx_u USING (k) JOIN fx_s USING (k) GROUP BY feature_idx, sample_idx)"
_PI = _FIT + ", pi AS (SELECT feature_idx, sample_idx, least(greatest((x + 2 * af) / 2, 1e-4::DOUBLE), 1 - 1e-4::DOUBLE) AS pi FROM ft JOIN fx_af USING (feature_idx))"


def _model_views(*names: str, more: str = "") -> str:
    return with_views("fx_af", "fx_gl", "fx_v", "fx_u", "fx_s", *names, more=more)


def _pi(spark, d):
    return hwe.individual_frequencies(fx.model_v(spark), fx.model_u(spark, d), _s(spark), _af(spark, d))


def _pi_rows(spark, d) -> tuple[DataFrame, np.ndarray]:
    """feature_idx, p0, p1, pi, af as arrays, and the sample ids."""
    ids, us = hwe.score_matrix(fx.model_u(spark, d), _s(spark))
    af = _af(spark, d).select("feature_idx", "af")
    rows = fx.likelihood_rows(spark, d).join(hwe.loading_rows(fx.model_v(spark)), "feature_idx").join(af, "feature_idx")
    return hwe.with_frequencies(rows, us), ids


def _g(spark, d):
    return frequency.centred(fx.dosage(spark, d), _af(spark, d))


@query("pi_map", _model_views(more=_PI) + "SELECT feature_idx, sample_idx, round(pi, 6) AS pi FROM pi")
def pi_map(spark, d):
    return _pi(spark, d).select("feature_idx", "sample_idx", F.round("pi", 6).alias("pi"))


@query(
    "resid_usv",
    _model_views(more=f"{_CENTRED}, {_FIT}, re AS (SELECT feature_idx, sample_idx, g - x AS g FROM g0 JOIN ft USING (feature_idx, sample_idx))")
    + f"SELECT feature_idx, sample_idx, {sql_r6('g - avg(g) OVER (PARTITION BY feature_idx) + 1e-9::DOUBLE')} AS g FROM re",
)
def resid_usv(spark, d):
    got = project.residuals(_g(spark, d), fx.model_u(spark, d), _s(spark), fx.model_v(spark))
    # many residuals end in a five at the seventh digit: a billionth more tells both engines where to
    return got.select("feature_idx", "sample_idx", r6(F.col("g") + F.lit(1e-9)).alias("g"))


def _prior_sql(f: str) -> str:
    a, b, c = (
        f"greatest((1 - pi) * (1 - pi) + pi * (1 - pi) * {f}, 1e-4::DOUBLE)",
        f"greatest(2.0::DOUBLE * pi * (1 - pi) * (1 - {f}), 1e-4::DOUBLE)",
        f"greatest(pi * pi + pi * (1 - pi) * {f}, 1e-4::DOUBLE)",
    )
    return f"{a} AS a, {b} AS b, {c} AS c"


def _hw_sql(steps: int) -> str:
    parts = [_PI, "hw0 AS (SELECT DISTINCT feature_idx, 0.0::DOUBLE AS f FROM fx_gl)"]
    for i in range(steps):
        parts.append(
            f"hw{i + 1} AS (SELECT feature_idx, least(greatest(1 - sum(p1 * b / t / (p0 * a / t + p1 * b / t + (1 - p0 - p1) * c / t)) / sum(2.0::DOUBLE * pi * (1 - pi)), -1.0::DOUBLE), 1.0::DOUBLE) AS f"
            f" FROM (SELECT *, a + b + c AS t FROM (SELECT feature_idx, p0, p1, pi, {_prior_sql('f')} FROM fx_gl JOIN pi USING (feature_idx, sample_idx) JOIN hw{i} USING (feature_idx)))"
            " GROUP BY feature_idx)"
        )
    return ", ".join(parts)


def _coef(spark, d, steps: int) -> DataFrame:
    return hwe.coefficients(_pi_rows(spark, d)[0], steps)


@query("hw_coef_1", _model_views(more=_hw_sql(1)) + f"SELECT feature_idx, {sql_r6('f')} AS f FROM hw1")
def hw_coef_1(spark, d):
    return _coef(spark, d, 1).select("feature_idx", r6(F.col("f")).alias("f"))


@query("hw_coef_3", _model_views(more=_hw_sql(3)) + f"SELECT feature_idx, {sql_r6('f')} AS f FROM hw3")
def hw_coef_3(spark, d):
    return _coef(spark, d, 3).select("feature_idx", r6(F.col("f")).alias("f"))


_LRT = (
    "lr AS (SELECT feature_idx, 2 * sum(ln((p0 * a + p1 * b + (1 - p0 - p1) * c) / (a + b + c)) - ln((p0 * a0 + p1 * b0 + (1 - p0 - p1) * c0) / (a0 + b0 + c0))) AS lrt"
    f" FROM (SELECT feature_idx, p0, p1, {_prior_sql('f')}, {_prior_sql('0').replace('AS a,', 'AS a0,').replace('AS b,', 'AS b0,').replace('AS c', 'AS c0')}"
    " FROM fx_gl JOIN pi USING (feature_idx, sample_idx) JOIN hw1 USING (feature_idx)) GROUP BY feature_idx)"
)


@query("hw_lrt", _model_views(more=_hw_sql(1) + ", " + _LRT) + f"SELECT feature_idx, {sql_r6('lrt')} AS lrt FROM lr")
def hw_lrt(spark, d):
    return _coef(spark, d, 1).select("feature_idx", r6(F.col("lrt")).alias("lrt"))


#: erfc(z) by the series 2 / sqrt(pi) exp(-z^2) sum z (2 z^2)^n / (2n + 1)!!, the double factorial through the gamma function.
_ERFC = (
    "CASE WHEN lrt >= 0 THEN CASE WHEN lrt > 100 THEN 0.0::DOUBLE WHEN lrt = 0 THEN 1.0::DOUBLE ELSE 1 - 2 / sqrt(pi()) * exp(-lrt / 2) * sqrt(lrt / 2)"
    " * list_sum(list_transform(range(0, 200), lambda n: exp(n * ln(lrt) - ((n + 1) * ln(2) + lgamma(n + 1.5::DOUBLE) - ln(pi()) / 2)))) END ELSE 1.0::DOUBLE END"
)


@query("hw_pval", _model_views(more=_hw_sql(1) + ", " + _LRT) + f"SELECT feature_idx, abs(round({_ERFC}, 6)) AS p FROM lr")
def hw_pval(spark, d):
    return hwe.p_value(_coef(spark, d, 1)).select("feature_idx", F.round("p", 6).alias("p"))


@query("hw_em")
def hw_em(spark, d):
    t = hwe.inbreeding(_pi_rows(spark, d)[0]).table
    return t.select("feature_idx", r6(F.col("f")).alias("f"), r6(F.col("lrt")).alias("lrt"), F.round("p", 6).alias("p"))


_MATCH = (
    "mt AS (SELECT t.feature_idx, r.ref_idx, NOT (t.a1 = r.a1 AND t.a2 = r.a2) AS flip, CASE WHEN t.a1 = r.a1 AND t.a2 = r.a2 THEN af ELSE 1 - af END AS af"
    " FROM fx_features t JOIN fx_refbim r ON t.snp_id = r.snp_id {on} WHERE (t.a1 = r.a1 AND t.a2 = r.a2) OR (t.a1 = r.a2 AND t.a2 = r.a1))"
)
_MATCH_PLINK = _MATCH.format(on="AND t.chr = r.chr AND t.bp = r.bp")


def _matched(spark, d):
    return project.match_sites(fx.features(spark), fx.reference_sites(spark, _af(spark, d)))


@query("proj_match", with_views("fx_refbim", more=_MATCH_PLINK) + "SELECT feature_idx, ref_idx, flip, round(af, 6) AS af FROM mt")
def proj_match(spark, d):
    return _matched(spark, d).withColumn("af", F.round("af", 6))


@query("proj_match_gl", with_views("fx_refbim", more=_MATCH.format(on="")) + "SELECT feature_idx, ref_idx, flip, round(af, 6) AS af FROM mt")
def proj_match_gl(spark, d):
    # the reference's alleles are numbered; half of the markers are named by their place
    ref = fx.reference_sites(spark, _af(spark, d), numeric=True)
    place = F.when((F.col("feature_idx") % 2 == 0) & (F.col("feature_idx") % 11 != 0), F.concat_ws("_", "chr", "bp")).otherwise(F.col("snp_id"))
    return project.match_markers(fx.features(spark).withColumn("snp_id", place), ref).withColumn("af", F.round("af", 6))


@query(
    "proj_loadings",
    with_views("fx_refbim", "fx_v", more=_MATCH_PLINK)
    + "SELECT mt.feature_idx, k, CASE WHEN flip AND v <> 0 THEN -v ELSE v END AS v FROM mt JOIN fx_v ON fx_v.feature_idx = mt.ref_idx",
)
def proj_loadings(spark, d):
    return project.matched_loadings(_matched(spark, d), fx.model_v(spark)).select("feature_idx", "k", (F.col("v") + 0.0).alias("v"))


@query(
    "harmonize",
    with_views("fx_refbim", "fx_dosage", "fx_features")
    + "SELECT r.ref_idx AS feature_idx, e.vec_id AS sample_idx, CASE WHEN r.ref_idx % 3 = 0 THEN NULL WHEN r.a1 = 'A' THEN dos ELSE 2 - dos END AS dos FROM fx_refbim r CROSS JOIN embeddings e"
    " JOIN fx_dosage x ON x.feature_idx = r.ref_idx AND x.sample_idx = e.vec_id WHERE r.ref_idx % 11 <> 0 AND r.ref_idx % 13 <> 0",
)
def harmonize(spark, d):
    ref = fx.reference_sites(spark, _af(spark, d)).filter((F.col("ref_idx") % 11 != 0) & (F.col("ref_idx") % 13 != 0))
    target = fx.features(spark).filter(F.col("feature_idx") % 3 != 0)
    return project.harmonise(ref, target, fx.dosage(spark, d))[0]


@query(
    "proj_1",
    _model_views(more=_CENTRED + ", pj AS (SELECT sample_idx, k, sum(g * v) / any_value(s) AS u FROM g0 JOIN fx_v USING (feature_idx) JOIN fx_s USING (k) GROUP BY sample_idx, k)")
    + "SELECT sample_idx, "
    + ", ".join(f"max(CASE WHEN k = {i} THEN {sql_r6('u')} END) AS pc{i + 1}" for i in range(3))
    + " FROM pj GROUP BY sample_idx",
)
def proj_1(spark, d):
    got = project.project_mean(_g(spark, d), fx.model_v(spark), _s(spark))
    return got.groupBy("sample_idx").agg(*[F.max(F.when(F.col("k") == i, r6(F.col("u")))).alias(f"pc{i + 1}") for i in range(3)])


def _seen(spark, d):
    rows = fx.dosage(spark, d).join(_af(spark, d), "feature_idx")
    return rows.select("feature_idx", "sample_idx", (F.col("dos") / 2.0 - F.col("af")).alias("g"))


_CRAMER = (
    "wv AS (SELECT feature_idx, max(CASE WHEN k = 0 THEN v * s END) AS x, max(CASE WHEN k = 1 THEN v * s END) AS y, max(CASE WHEN k = 2 THEN v * s END) AS z FROM fx_v JOIN fx_s USING (k) GROUP BY feature_idx),"
    " ne AS (SELECT sample_idx, sum(x * x) AS a, sum(x * y) AS b, sum(x * z) AS c, sum(y * y) AS e, sum(y * z) AS f, sum(z * z) AS i, sum(x * g) AS p, sum(y * g) AS q, sum(z * g) AS r"
    " FROM (SELECT d.feature_idx, sample_idx, dos / 2.0::DOUBLE - af AS g FROM fx_dosage d JOIN fx_af a ON a.feature_idx = d.feature_idx WHERE dos IS NOT NULL) JOIN wv USING (feature_idx) GROUP BY sample_idx),"
    " dt AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM ne)"
)


@query(
    "proj_2",
    _model_views(more=_CRAMER)
    + f"SELECT sample_idx, {sql_r6('(p * (e * i - f * f) - b * (q * i - f * r) + c * (q * f - e * r)) / det')} AS pc1,"
    f" {sql_r6('(a * (q * i - f * r) - p * (b * i - f * c) + c * (b * r - q * c)) / det')} AS pc2,"
    f" {sql_r6('(a * (e * r - q * f) - b * (b * r - q * c) + p * (b * f - e * c)) / det')} AS pc3 FROM dt",
)
def proj_2(spark, d):
    got = project.project_least_squares(_seen(spark, d), fx.model_v(spark), _s(spark))
    return got.select("sample_idx", *[r6(F.get("pcs", F.lit(i))).alias(f"pc{i + 1}") for i in range(3)])


_CRAMER_E = _CRAMER.replace("(SELECT d.feature_idx, sample_idx, dos / 2.0::DOUBLE - af AS g FROM fx_dosage d JOIN fx_af a ON a.feature_idx = d.feature_idx WHERE dos IS NOT NULL)", "cells")
_SOLVED = (
    "(p * (e * i - f * f) - b * (q * i - f * r) + c * (q * f - e * r)) / det",
    "(a * (q * i - f * r) - p * (b * i - f * c) + c * (b * r - q * c)) / det",
    "(a * (e * r - q * f) - b * (b * r - q * c) + p * (b * f - e * c)) / det",
)


def _proj_gl_sql() -> str:
    """Least squares of the posterior dosages under the reference's frequencies, then one step under U S V'."""
    solved = ", ".join(f"{x} AS u{i}" for i, x in enumerate(_SOLVED))
    start = f"{_W}, cells AS (SELECT feature_idx, sample_idx, (w1 + 2 * w2) / (w0 + w1 + w2) - 2 * af AS g FROM w), {_CRAMER_E}, first AS (SELECT sample_idx, {solved} FROM dt)"
    wide = ", pp AS (SELECT feature_idx, sample_idx, least(greatest((x * u0 + y * u1 + z * u2 + 2 * af) / 2, 1e-4::DOUBLE), 1 - 1e-4::DOUBLE) AS pi FROM wv JOIN fx_af USING (feature_idx), first)"
    post = (
        ", w_2 AS (SELECT feature_idx, sample_idx, af, p0 * (1 - pi) * (1 - pi) AS w0, p1 * 2.0::DOUBLE * pi * (1 - pi) AS w1, (1 - p0 - p1) * pi * pi AS w2"
        " FROM fx_gl JOIN pp USING (feature_idx, sample_idx) JOIN fx_af USING (feature_idx))"
        ", cells_2 AS (SELECT feature_idx, sample_idx, (w1 + 2 * w2) / (w0 + w1 + w2) - 2 * af AS g FROM w_2)"
    )
    again = ", " + _CRAMER_E.partition("), ne AS ")[2].replace("FROM cells JOIN", "FROM cells_2 JOIN").replace(" dt AS", " dt_2 AS").replace("FROM ne)", "FROM ne_2)")
    again = ", ne_2 AS " + again.removeprefix(", ")
    return _model_views(more=start + wide + post + again) + "SELECT sample_idx, " + ", ".join(f"{sql_r6(x)} AS pc{i + 1}" for i, x in enumerate(_SOLVED)) + " FROM dt_2"


@query("proj_gl_1", _proj_gl_sql())
def proj_gl_1(spark, d):
    """The projection of likelihoods after one step."""
    got = project.project_likelihoods(fx.likelihoods(spark, d), fx.model_v(spark), _s(spark), _af(spark, d), steps=1)
    return got.select("sample_idx", *[r6(F.get("pcs", F.lit(i))).alias(f"pc{i + 1}") for i in range(3)])


@query("proj_gl")
def proj_gl(spark, d):
    got = project.project_likelihoods(fx.likelihoods(spark, d), fx.model_v(spark), _s(spark), _af(spark, d))
    return got.select("sample_idx", *[r6(F.get("pcs", F.lit(i))).alias(f"pc{i + 1}") for i in range(3)])


# --- decompositions ----------------------------------------------------------------------------


def _std_rows(spark, d) -> DataFrame:
    return frequency.genotype_rows(frequency.frequency_rows(fx.dosage_rows(spark, d)), True)


@query(
    "gram",
    with_views("fx_af", more=_CENTRED)
    + f"SELECT a.sample_idx AS i, b.sample_idx AS j, {sql_r6('sum(a.g * b.g) / 64')} AS c FROM g0 a JOIN g0 b ON a.feature_idx = b.feature_idx GROUP BY 1, 2",
)
def gram_query(spark, d):
    ids = [r[0] for r in fx.samples(spark, d).select("sample_idx").orderBy("sample_idx").collect()]
    rows = _rows(spark, d)
    return tiles.gram(rows, len(ids)).scaled(1 / rows.count()).cells(ids, 6)


_COVD = (
    _PI
    + ", cv AS (SELECT sample_idx, sum(CASE WHEN 2 * af * (1 - af) > 1e-9 THEN (w0 * 4 * af * af + w1 * (1 - 2 * af) * (1 - 2 * af) + w2 * (2 - 2 * af) * (2 - 2 * af)) / (w0 + w1 + w2) / (2 * af * (1 - af)) ELSE 0 END) AS d"
    " FROM (SELECT sample_idx, af, p0 * (1 - pi) * (1 - pi) AS w0, p1 * 2.0::DOUBLE * pi * (1 - pi) AS w1, (1 - p0 - p1) * pi * pi AS w2 FROM fx_gl JOIN pi USING (feature_idx, sample_idx) JOIN fx_af USING (feature_idx)) GROUP BY sample_idx)"
)


@query("cov_diag", _model_views(more=_COVD) + f"SELECT sample_idx, {sql_r6('d')} AS d FROM cv")
def cov_diag(spark, d):
    rows, ids = _pi_rows(spark, d)
    af = _af(spark, d).select("feature_idx", "af")
    got = em.covariance_diagonal(rows.join(af, "feature_idx"), len(ids))
    return spark.createDataFrame([(int(i), float(x)) for i, x in zip(ids, got)], "sample_idx long, d double").withColumn("d", r6(F.col("d")))


@query(
    "pca_trace",
    with_views("fx_af", more=_CENTRED)
    + "SELECT round(sum(g * g / (CASE WHEN 2 * af * (1 - af) > 1e-18 THEN 2 * af * (1 - af) ELSE 1 END)), 4) AS trace FROM g0",
)
def pca_trace(spark, d):
    """The squared singular values of a full decomposition add up to the squared cells."""
    s = pca.full(_std_rows(spark, d)).s
    return spark.range(1).select(F.round(F.lit(float((s**2).sum())), 4).alias("trace"))


def _spectrum(method: str, k: int = 5):
    def run(spark, d):
        fit = pca.pca(_std_rows(spark, d), PcaParams(k=k, method=method, windows=8))
        vals = fit.eigenvalues()
        rows = [(i + 1, float(fit.s[i]), float(vals[i])) for i in range(len(fit.s))]
        return spark.createDataFrame(rows, "pc int, s double, eigval double").select("pc", F.round("s", 3).alias("s"), F.round("eigval", 3).alias("eigval"))

    return run


for _m in ("full", "iram", "ssvd", "winsvd"):
    query(f"pca_{_m}")(_spectrum(_m))


@query("pca_scores")
def pca_scores(spark, d):
    fit = pca.pca(_std_rows(spark, d), PcaParams(k=3, method="ssvd"))
    ids = fx.samples(spark, d).select("sample_idx").orderBy("sample_idx").toArrow().column("sample_idx")
    scores = spark.createDataFrame(pa.table({"sample_idx": ids} | {f"pc{i + 1}": fit.u[:, i] for i in range(3)}))
    return fx.samples(spark, d).join(scores, "sample_idx").select("fid", "iid", *[r6(F.col(f"pc{i}")).alias(f"pc{i}") for i in (1, 2, 3)])


@query("em_emu")
def em_emu(spark, d):
    rows = em.seen_rows(frequency.frequency_rows(fx.dosage_rows(spark, d)))
    fit, _ = em.emu(rows, PcaParams(k=3, method="ssvd"))
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(fit.s)], "pc int, s double").withColumn("s", F.round("s", 3))


@query("em_pcangsd")
def em_pcangsd(spark, d):
    rows = fx.likelihood_rows(spark, d).join(_af(spark, d).select("feature_idx", "af"), "feature_idx")
    _, cov, _ = em.pcangsd(rows, PcaParams(k=3, method="ssvd"))
    w, _ = cov.leading(3)
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(w)], "pc int, eigval double").withColumn("eigval", F.round("eigval", 3))


# --- windows, orders, measures ------------------------------------------------------------------


# vectors of `embeddings` as loadings: a feature for each row, its first three numbers, and the next three for a second model
_LOADINGS = "xy AS (SELECT vec_id AS feature_idx, k, embedding[k + 1]::DOUBLE AS x, embedding[k + 4]::DOUBLE AS y FROM embeddings, (SELECT unnest([0, 1, 2]) AS k))"


def _vectors(spark, d, first: int) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("feature_idx"), F.transform(F.slice("embedding", first + 1, 3), lambda x: x.cast("double")).alias("pcs"))


def _loadings(spark, d) -> DataFrame:
    return _vectors(spark, d, 0).select("feature_idx", F.posexplode("pcs").alias("k", "v"))


@query(
    "runmax_loadings",
    "WITH " + _LOADINGS + " SELECT feature_idx, k::INT AS k, abs(max(x) OVER (PARTITION BY k ORDER BY feature_idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) AS v FROM xy",
)
def runmax_loadings(spark, d):
    return ldstats.running_max(_loadings(spark, d), "feature_idx", "v", ["k"], 10)


@query("cummean", "WITH " + _LOADINGS + f" SELECT feature_idx, k::INT AS k, {sql_r6('avg(x) OVER (PARTITION BY k ORDER BY feature_idx ROWS UNBOUNDED PRECEDING)')} AS v FROM xy")
def cummean(spark, d):
    return ldstats.cumulative_mean(_loadings(spark, d), "feature_idx", "v", ["k"]).withColumn("v", r6(F.col("v")))


def _parts(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") - 1).alias("feature_idx"))


@query("perm_band", "SELECT row_number() OVER (ORDER BY (p_partkey - 1) % 8, p_partkey) - 1 AS new_pos, p_partkey - 1 AS feature_idx FROM part")
def perm_band(spark, d):
    return permute.band_order(_parts(spark, d), 8)


@query("perm_random", "SELECT p_partkey - 1 AS feature_idx, ('0x' || substr(md5('101:' || (p_partkey - 1)), 1, 15))::BIGINT AS perm_key FROM part")
def perm_random(spark, d):
    return permute.random_order(_parts(spark, d), 101)


def _agreement(spark, d):
    return matrix.agreement(_vectors(spark, d, 0), _vectors(spark, d, 3), 3)


@query(
    "mev",
    "WITH " + _LOADINGS
    + " SELECT round(avg(nrm), 6) AS value FROM (SELECT jy, sqrt(sum(d * d)) AS nrm FROM (SELECT a.k AS jx, b.k AS jy, sum(a.x * b.y) AS d FROM xy a JOIN xy b ON a.feature_idx = b.feature_idx GROUP BY a.k, b.k) GROUP BY jy)",
)
def mev(spark, d):
    return spark.range(1).select(F.round(F.lit(_agreement(spark, d)["mev"]), 6).alias("value"))


@query(
    "rmse",
    "WITH " + _LOADINGS + ", sg AS (SELECT k, CASE WHEN sum(abs(x - y)) > 2 * sum(abs(x + y)) THEN -1 ELSE 1 END AS s FROM xy GROUP BY k)"
    + " SELECT round(sqrt(avg((x - s * y) * (x - s * y))), 6) AS value FROM xy JOIN sg USING (k)",
)
def rmse(spark, d):
    return spark.range(1).select(F.round(F.lit(_agreement(spark, d)["rmse"]), 6).alias("value"))


@query(
    "min_sse",
    "WITH " + _LOADINGS
    + " SELECT k::BIGINT AS k, round(min(least(m, p)), 6) AS value FROM (SELECT a.k AS k, b.k AS j, sum((a.x - b.y) * (a.x - b.y)) AS m, sum((a.x + b.y) * (a.x + b.y)) AS p FROM xy a JOIN xy b ON a.feature_idx = b.feature_idx GROUP BY a.k, b.k) GROUP BY k",
)
def min_sse(spark, d):
    got = _agreement(spark, d)["min_sse"]
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(got)], "k long, value double").withColumn("value", F.round("value", 6))


@query("lgamma_fn", "SELECT x::DOUBLE AS x, round(lgamma(x), 6) AS value FROM (SELECT unnest([0.5, 1.5, 2.5, 10.25, 100.0]::DOUBLE[]) AS x)")
def lgamma_fn(spark, d):
    rows = [(x, special.lgamma(x)) for x in (0.5, 1.5, 2.5, 10.25, 100.0)]
    return spark.createDataFrame(rows, "x double, value double").withColumn("value", F.round("value", 6))


# erfc(x) and P(1/2, x) = erf(sqrt(x)) by the power series of erf, I_0.3(2, 3) as a binomial tail, the two-sided tail of all tables with the margins
_SPECIAL = """
WITH fact AS (SELECT n, coalesce((SELECT product(i::DOUBLE) FROM unnest(range(1, n + 1)) t(i)), 1.0::DOUBLE) AS f FROM (SELECT unnest(range(0, 31))::INT AS n)),
choose AS (SELECT a.n AS n, b.n AS k, a.f / (b.f * c.f) AS c FROM fact a JOIN fact b ON b.n <= a.n JOIN fact c ON c.n = a.n - b.n),
erf AS (
  SELECT x, sum((CASE WHEN n % 2 = 0 THEN 2 ELSE -2 END) / sqrt(pi()) * pow(x, 2 * n + 1) / (f * (2 * n + 1))) AS e
  FROM fact, (VALUES (0.5::DOUBLE), (sqrt(2.0::DOUBLE))) v(x) GROUP BY x
),
tables AS (
  SELECT a.k AS n11, a.c * b.c / m.c AS p FROM choose a JOIN choose b ON b.n = 4 AND b.k = 4 - a.k JOIN choose m ON m.n = 8 AND m.k = 4 WHERE a.n = 4
)
SELECT 'erfc' AS name, 0.5::DOUBLE AS x, round(1 - e, 6) AS value FROM erf WHERE x < 1
UNION ALL SELECT 'gamma_p', 2.0::DOUBLE, round(e, 6) FROM erf WHERE x > 1
UNION ALL SELECT 'gamma_q', 2.0::DOUBLE, round(1 - e, 6) FROM erf WHERE x > 1
UNION ALL SELECT 'beta_i', 0.3::DOUBLE, round(sum(c * pow(0.3::DOUBLE, k) * pow(0.7::DOUBLE, 4 - k)), 6) FROM choose WHERE n = 4 AND k >= 2
UNION ALL SELECT 'fisher', 3.0::DOUBLE, round(sum(p), 6) FROM tables WHERE p <= (SELECT p FROM tables WHERE n11 = 3) * (1 + 1e-7)
"""


@query("special_fn", _SPECIAL)
def special_fn(spark, d):
    rows = [("erfc", 0.5, special.erfc(0.5)), ("gamma_p", 2.0, special.gamma_p(0.5, 2.0)), ("gamma_q", 2.0, special.gamma_q(0.5, 2.0))]
    rows += [("beta_i", 0.3, special.beta_i(2, 3, 0.3)), ("fisher", 3.0, special.fisher_exact(3, 1, 1, 3)[3])]
    return spark.createDataFrame(rows, "name string, x double, value double").withColumn("value", F.round("value", 6))
