"""Projection of new samples on a saved model, and matching their sites to the model's."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.operators.frequency import field
from karst.operators.lineage import cut
from karst.operators.matrix import block, map_arrays, reduce_arrays
from karst.operators.slices import few_features, slices


def first_of(ref: DataFrame, *key: str) -> DataFrame:
    """Of reference rows that share a key, the first."""
    w = Window.partitionBy(*key).orderBy("ref_idx")
    return ref.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def match_sites(target: DataFrame, ref: DataFrame) -> DataFrame:
    """feature_idx, ref_idx, flip, af of target sites in the reference.

    Sites meet by id and must agree in chromosome and position; equal alleles keep the reference's
    frequency, swapped ones take 1 - af and are flipped, others are no match.
    """
    r = first_of(ref, "snp_id").select(
        "ref_idx", "snp_id", F.col("chr").alias("r_chr"), F.col("bp").alias("r_bp"), F.col("a1").alias("r_a1"), F.col("a2").alias("r_a2"), "af"
    )
    rows = target.drop("af").join(r, "snp_id").filter((F.col("chr") == F.col("r_chr")) & (F.col("bp") == F.col("r_bp")))
    return _alleles(rows)


def _alleles(rows: DataFrame) -> DataFrame:
    same = (F.col("a1") == F.col("r_a1")) & (F.col("a2") == F.col("r_a2"))
    swapped = (F.col("a1") == F.col("r_a2")) & (F.col("a2") == F.col("r_a1"))
    return rows.filter(same | swapped).select(
        "feature_idx", "ref_idx", (~same).alias("flip"), F.when(same, F.col("af")).otherwise(1 - F.col("af")).alias("af")
    )


def require_overlap(matched: DataFrame) -> DataFrame:
    if matched.isEmpty():
        raise ValueError("no site of the target is in the reference")
    return matched


def match_markers(target: DataFrame, ref: DataFrame) -> DataFrame:
    """As match_sites for markers: by id, else by `chr_pos`; alleles may be numbered 0 to 3."""
    letters = lambda c: F.when(F.length(c) == 1, F.translate(c, "0123", "ACGT")).otherwise(c)
    t = target.drop("af").withColumn("a1", letters(F.col("a1"))).withColumn("a2", letters(F.col("a2")))
    r = ref.withColumn("r_a1", letters(F.col("a1"))).withColumn("r_a2", letters(F.col("a2")))
    own = first_of(r, "snp_id").select(F.col("snp_id").alias("key"), F.struct("ref_idx", "r_a1", "r_a2", "af").alias("by_id"))
    place = first_of(r.withColumn("place", F.concat_ws("_", "chr", "bp")), "place").select("place", F.struct("ref_idx", "r_a1", "r_a2", "af").alias("by_place"))
    rows = t.join(own, t["snp_id"] == own["key"], "left").join(place, t["snp_id"] == place["place"], "left")
    rows = rows.withColumn("hit", F.coalesce("by_id", "by_place")).filter("hit is not null")
    return _alleles(rows.select("feature_idx", "a1", "a2", "hit.ref_idx", "hit.r_a1", "hit.r_a2", "hit.af"))


def matched_loadings(matched: DataFrame, v: DataFrame) -> DataFrame:
    """feature_idx, k, v: the reference's loadings of matched sites, negated where flipped."""
    r = v.withColumnRenamed("feature_idx", "ref_idx")
    return matched.join(r, "ref_idx").select("feature_idx", "k", F.when(F.col("flip"), -F.col("v")).otherwise(F.col("v")).alias("v"))


def project_mean(cells: DataFrame, v: DataFrame, s: DataFrame) -> DataFrame:
    """sample_idx, k, u = sum over features of g v / s; missing cells of g count as 0 (the mean)."""
    rows = cells.join(v, "feature_idx").join(F.broadcast(s), "k")
    return rows.groupBy("sample_idx", "k").agg((F.sum(F.coalesce("g", F.lit(0.0)) * F.col("v")) / F.first("s")).alias("u"))


def normal_equations(cells: DataFrame, v: DataFrame, s: DataFrame) -> DataFrame:
    """sample_idx, a (k x k, row by row), b (k): sums over the observed cells only."""
    vs = v.join(F.broadcast(s), "k").groupBy("feature_idx").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("v") * F.col("s")).alias("x")))).alias("w"))
    vs = vs.select("feature_idx", F.transform("w", lambda c: c["x"]).alias("w"))
    k = s.count()
    rows = cells.filter("g is not null").join(vs, "feature_idx")
    w = [F.get("w", F.lit(i)) for i in range(k)]
    sums = [F.sum(w[i] * w[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w[i] * F.col("g")).alias(f"b{i}") for i in range(k)]
    got = rows.groupBy("sample_idx").agg(*sums)
    a = F.array(*[F.col(f"a{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    return got.select("sample_idx", a.alias("a"), F.array(*[F.col(f"b{i}") for i in range(k)]).alias("b"))


def project_least_squares(cells: DataFrame, v: DataFrame, s: DataFrame) -> DataFrame:
    """sample_idx, pcs: least squares of the observed cells on the rows of V S.

    The sums are grouped in Spark; only k x k systems reach numpy, a batch of samples at a time.
    """
    k = s.count()

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            a = np.array(pdf["a"].tolist()).reshape(-1, k, k)
            b = np.array(pdf["b"].tolist())
            u = np.einsum("nij,nj->ni", np.linalg.pinv(a), b)
            yield pd.DataFrame({"sample_idx": pdf["sample_idx"], "pcs": list(u)})

    return normal_equations(cells, v, s).mapInPandas(solve, "sample_idx long, pcs array<double>")


def rows_normal(rows: DataFrame, k: int, n: int) -> np.ndarray:
    """Least squares of each sample's observed cells on the features' weights, of rows (feature_idx, g, w): samples x k.

    A pass adds up each sample's normal equations (N k (k + 3) / 2 numbers) in blocks of samples.
    """
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    packed = rows.select("feature_idx", F.concat("g", "w").alias("values"))

    def partial(_, x, total):
        g, w = x[:, :n], x[:, n:]
        seen = ~np.isnan(g)
        total["a"] += seen.T.astype(float) @ np.stack([w[:, i] * w[:, j] for i, j in pairs], 1)
        total["b"] += np.where(seen, g, 0.0).T @ w

    got = reduce_arrays(packed, partial, {"a": (n, len(pairs)), "b": (n, k)})
    return _solved(got["a"], got["b"])


def _solved(sums: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of samples from the upper triangles (samples x k (k + 1) / 2) and right sides of their normal equations."""
    n, k = b.shape
    a = np.zeros((n, k, k))
    for c, (i, j) in enumerate((i, j) for i in range(k) for j in range(i, k)):
        a[:, i, j] = a[:, j, i] = sums[:, c]
    return np.einsum("nij,nj->ni", np.linalg.pinv(a), b) if n else np.zeros((0, k))


def project_likelihood_rows(
    gl: DataFrame, w: DataFrame, af: DataFrame, n: int, k: int, max_iter: int = 100, tol: float = 1e-5, steps: int | None = None
) -> np.ndarray:
    """Scores (samples x k) of rows gl (feature_idx, p0, p1) on w (feature_idx, w: loadings times singular values).

    Posterior dosages under the reference's frequencies, least squares, then posteriors under U S V' until
    the scores' relative change is below tol. An iteration is one pass; the scores are broadcast. Few features of
    more samples take two passes in all, see _project_slices.
    """
    table = cut(gl.join(w, "feature_idx").join(af.select("feature_idx", "af"), "feature_idx").select("feature_idx", "p0", "p1", "w", "af"), "gl")
    found = few_features(table.select("feature_idx", F.col("p0").alias("values")))
    if found:
        return _project_slices(table, *found, k, max_iter, tol, steps)

    def expected(p0, p1, w, af, u):
        return _expected(p0, p1, w, af, u), w

    u = None
    for _ in range(1 + (max_iter if steps is None else steps)):
        new = rows_normal(map_arrays(table, expected, u, "feature_idx long, g array<double>, w array<double>"), k, n)
        close = u is not None and np.linalg.norm(new - u) < tol * max(np.linalg.norm(u), 1e-300)
        u = new
        if close and steps is None:
            break
    return u


def _expected(p0: np.ndarray, p1: np.ndarray, w: np.ndarray, af: np.ndarray, u: np.ndarray | None) -> np.ndarray:
    f = af[:, None]
    pi = f if u is None else np.clip((w @ u.T + 2 * f) / 2, 1e-4, 1 - 1e-4)
    w0, w1, w2 = p0 * (1 - pi) ** 2, p1 * 2 * pi * (1 - pi), (1 - p0 - p1) * pi**2
    return (w1 + 2 * w2) / (w0 + w1 + w2) - 2 * f


def _project_slices(table: DataFrame, features: np.ndarray, n: int, k: int, max_iter: int, tol: float, steps: int | None) -> np.ndarray:
    """As project_likelihood_rows, of few features, in slices of samples.

    A sample's steps need that sample alone; only the step to stop at is common. The first pass adds up each
    step's changes, the second makes that many steps, and only its scores reach the driver.
    """
    got = table.select("feature_idx", "w", "af").toArrow().sort_by("feature_idx")
    w, af = block(got.column("w").combine_chunks()), got.column("af").to_numpy()
    both = np.stack([w[:, i] * w[:, j] for i in range(k) for j in range(i, k)], 1)
    parts = slices(table, features, n, ("p0", "p1"))
    # samples without a gap share one system
    whole = np.linalg.pinv(w.T @ w)

    def scores(p0, p1, most):
        u = None
        for _ in range(most):
            g = _expected(p0, p1, w, af, u)
            seen = ~np.isnan(g)
            u = g.T @ w @ whole if seen.all() else _solved(seen.T.astype(float) @ both, np.where(seen, g, 0.0).T @ w)
            yield u

    def changes(_, cols, total):
        before = None
        for i, u in enumerate(scores(*cols, 1 + max_iter)):
            if before is not None:
                change, size = ((u - before) ** 2).sum(), (before**2).sum()
                total["x"][i] += change, size
                if change <= (1e-6 * tol) ** 2 * size:  # the rest adds nothing that could be seen
                    total["x"][i + 1 :, 1] += size
                    break
            before = u

    if steps is None:
        change, size = np.sqrt(parts.sums(changes, {"x": (1 + max_iter, 2)})["x"]).T
        close = np.flatnonzero(change[1:] < tol * np.maximum(size[1:], 1e-300))
        steps = int(close[0]) + 1 if len(close) else max_iter

    def last(_, cols, most):
        *_, u = scores(*cols, most)
        return u

    return parts.scores(last, 1 + steps, k)


def project_likelihoods(gl: DataFrame, v: DataFrame, s: DataFrame, af: DataFrame, max_iter: int = 100, tol: float = 1e-5, steps: int | None = None) -> DataFrame:
    """sample_idx, pcs from long-form likelihoods; each sample must have a cell of each feature."""
    ids = gl.select("sample_idx").distinct().orderBy("sample_idx").toArrow().column("sample_idx").combine_chunks()
    cells = gl.groupBy("feature_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "p0", "p1"))).alias("c"))
    rows = cells.select("feature_idx", *[F.transform("c", field(x)).alias(x) for x in ("p0", "p1")])
    w, k = weights(v, s)
    u = project_likelihood_rows(rows, w, af, len(ids), k, max_iter, tol, steps)
    ends = pa.array(np.arange(len(u) + 1) * k, pa.int32())
    return gl.sparkSession.createDataFrame(pa.table({"sample_idx": ids, "pcs": pa.ListArray.from_arrays(ends, pa.array(u.ravel()))}))


def weights(v: DataFrame, s: DataFrame) -> tuple[DataFrame, int]:
    """feature_idx, w: long-form loadings times singular values, as arrays; and their number."""
    from karst.operators.hwe import loading_rows

    scale = [float(r["s"]) for r in s.orderBy("k").collect()]
    rows = loading_rows(v).select("feature_idx", F.zip_with("w", F.array(*map(F.lit, scale)), lambda a, b: a * b).alias("w"))
    return rows, len(scale)


def project_rows(method: int, rows: DataFrame, k: int, n: int, s: np.ndarray) -> np.ndarray:
    """Scores (samples x k) of rows (feature_idx, g, w) by method 1 or 2; w are loadings times the singular values s."""
    if method == 2:
        return rows_normal(rows, k, n)
    if method != 1:
        raise NotImplementedError(f"projection method {method}")

    def partial(_, x, total):
        total["u"] += np.nan_to_num(x[:, :n], nan=0.0).T @ x[:, n:]

    return reduce_arrays(rows.select("feature_idx", F.concat("g", "w").alias("values")), partial, {"u": (n, k)})["u"] / s**2


def project(method: int, *args, **kwargs) -> DataFrame:
    """Method 1 means imputation by the mean, 2 least squares; 3 (Procrustes) isn't supported."""
    if method == 1:
        return project_mean(*args, **kwargs)
    if method == 2:
        return project_least_squares(*args, **kwargs)
    raise NotImplementedError(f"projection method {method}")


def harmonise(ref: DataFrame, target: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Align target genotypes to a reference's sites: (feature_idx of the reference, sample_idx, dos), and counters.

    Exact sites are taken as they are, swapped ones mirrored, absent ones all missing; a site of the
    same id with another position or other alleles is an error.
    """
    t = target.select(
        F.col("feature_idx").alias("t_idx"), "snp_id", F.col("chr").alias("t_chr"), F.col("bp").alias("t_bp"), F.col("a1").alias("t_a1"), F.col("a2").alias("t_a2")
    )
    rows = ref.join(t, "snp_id", "left")
    same = (F.col("a1") == F.col("t_a1")) & (F.col("a2") == F.col("t_a2"))
    swapped = (F.col("a1") == F.col("t_a2")) & (F.col("a2") == F.col("t_a1"))
    kind = (
        F.when(F.col("t_idx").isNull(), "absent")
        .when((F.col("chr") != F.col("t_chr")) | (F.col("bp") != F.col("t_bp")) | ~(same | swapped), "clash")
        .when(same, "exact")
        .otherwise("swapped")
    )
    rows = rows.withColumn("kind", kind)
    counters = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    bad = rows.filter("kind = 'clash'").select("snp_id").limit(1).collect()
    if bad:
        raise ValueError(f"site {bad[0][0]} has another position or other alleles in the reference")
    samples = cells.select("sample_idx").distinct()
    present = rows.filter("kind <> 'absent'").join(cells.withColumnRenamed("feature_idx", "t_idx"), "t_idx")
    present = present.select("ref_idx", "sample_idx", F.when(F.col("kind") == "swapped", 2 - F.col("dos")).otherwise(F.col("dos")).alias("dos"))
    everyone = samples.agg(F.collect_list("sample_idx").alias("all"))
    absent = rows.filter("kind = 'absent'").crossJoin(F.broadcast(everyone)).select("ref_idx", F.explode("all").alias("sample_idx"), F.lit(None).cast("long").alias("dos"))
    return present.unionByName(absent).withColumnRenamed("ref_idx", "feature_idx"), counters


def residuals(cells: DataFrame, u: DataFrame, s: DataFrame, v: DataFrame, centre: bool = True) -> DataFrame:
    """feature_idx, sample_idx, g - U S V', then minus the feature's mean; long-form model tables.

    Cells are brought together by feature, and meet U S (broadcast, 8 N k bytes) there; each sample must
    have a cell of each feature.
    """
    from karst.operators.hwe import cells_of, loading_rows, score_matrix
    from karst.operators.ld import to_rows

    ids, us = score_matrix(u, s)
    rows = to_rows(cells.select("feature_idx", "sample_idx", "g")).join(loading_rows(v), "feature_idx").select("feature_idx", "values", "w")

    def run(g, w, shared):
        rest = g - w @ shared.T
        return (rest - rest.mean(1, keepdims=True) if centre else rest,)

    return cells_of(map_arrays(rows, run, us, "feature_idx long, g array<double>"), ["g"], ids)


def predict_missing(rows: DataFrame, u: np.ndarray, af_bounds: bool = True) -> DataFrame:
    """Rows (feature_idx, values with null where missing, af): each feature's observed values are
    regressed on U, and missing ones take the prediction within [-af, 1 - af]."""
    from karst.operators.matrix import block, rows_batch

    shared = rows.sparkSession.sparkContext.broadcast(u)

    def run(batches):
        m = shared.value
        for b in batches:
            if not len(b):
                continue
            x, af = block(b.column(1)).astype(float), b.column(2).to_numpy()
            for i in range(len(x)):
                gone = np.isnan(x[i])
                if gone.any():
                    beta = np.linalg.lstsq(m[~gone], x[i, ~gone], rcond=None)[0]
                    x[i, gone] = np.clip(m[gone] @ beta, -af[i], 1 - af[i]) if af_bounds else m[gone] @ beta
            yield rows_batch(b.column(0), x)

    return rows.select("feature_idx", "values", "af").mapInArrow(run, "feature_idx long, values array<double>")
