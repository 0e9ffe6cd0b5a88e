"""Deterministic genotype-like inputs derived from the driver's tables, in Spark and in SQL.

Each function has a twin in SQL: the text of a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.operators.frequency import field

N_FEATURES = 64


def r6(x: Column) -> Column:
    """Six digits, without a negative zero."""
    y = F.round(x, 6)
    return F.when(y == 0, F.lit(0.0)).otherwise(y)


def sql_r6(x: str) -> str:
    return f"(CASE WHEN round({x}, 6) = 0 THEN 0.0::DOUBLE ELSE round({x}, 6) END)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_idx"), F.concat(F.lit("L"), "label").alias("fid"), F.concat(F.lit("S"), "vec_id").alias("iid")
    )


def features(spark: SparkSession) -> DataFrame:
    f = F.col("id")
    return spark.range(N_FEATURES).select(
        f.alias("feature_idx"),
        (F.floor(f / 16) + 1).cast("string").alias("chr"),
        F.concat(F.lit("rs"), f.cast("string")).alias("snp_id"),
        (1000 + (f % 16) * 1000 + (f * 37) % 300).alias("bp"),
        F.lit("A").alias("a1"),
        F.lit("G").alias("a2"),
    )


def dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_idx, sample_idx, dos (copies of the first allele, null where missing)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_idx"), "embedding", F.posexplode("embedding").alias("f", "own"))
    f = F.col("f").cast("long")
    x = F.get("embedding", (F.floor(F.col("f") / 4) * 4).cast("int")).cast("double") + F.lit(0.3) * F.col("own").cast("double")
    step = F.lit(0.01) * (f % 32)
    dos = (
        F.when((F.col("sample_idx") * 7 + f * 13) % 29 == 0, None)
        .when(F.col("x") < F.lit(-0.25) + step, 0)
        .when(F.col("x") < F.lit(-0.05) + step, 1)
        .otherwise(2)
    )
    return e.withColumn("x", x).select(f.alias("feature_idx"), "sample_idx", dos.cast("long").alias("dos"))


def dosage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_idx, dos: an array over the samples in the order of sample_idx, as files hold them."""
    rows = dosage(spark, sf_dir).groupBy("feature_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "dos"))).alias("c"))
    return rows.select("feature_idx", F.transform("c", lambda c: c["dos"]).alias("dos"))


def likelihood_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_idx, p0, p1 as arrays."""
    rows = likelihoods(spark, sf_dir).groupBy("feature_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "p0", "p1"))).alias("c"))
    return rows.select("feature_idx", *[F.transform("c", field(x)).alias(x) for x in ("p0", "p1")])


def likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_idx, sample_idx, p0 (no copy), p1 (one copy): smoothed calls, a third each where missing."""
    d = F.col("dos")
    miss = F.lit(1.0) / F.lit(3.0)
    return dosage(spark, sf_dir).select(
        "feature_idx",
        "sample_idx",
        F.when(d.isNull(), miss).when(d == 0, 0.9).otherwise(0.05).alias("p0"),
        F.when(d.isNull(), miss).when(d == 1, 0.9).otherwise(0.05).alias("p1"),
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_idx, sample_idx, x: a sparse count matrix."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("feature_idx"), F.col("l_suppkey").alias("sample_idx"), "l_quantity")
    return rows.groupBy("feature_idx", "sample_idx").agg(F.sum("l_quantity").cast("long").alias("x"))


def count_axes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All features and samples of `counts`, and one of each without a count."""
    people = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_idx"))
    empty = spark.range(1).select(F.lit(-1).cast("long").alias("sample_idx"))
    return spark.range(201).select(F.col("id").alias("feature_idx")), people.unionByName(empty)


def assoc(spark: SparkSession) -> DataFrame:
    """A table of associations; every ninth site has a second row further down, with a smaller p."""
    f = F.col("feature_idx")
    y = ((f * 29 + 7) % 64 + 1).cast("double") / 64
    rows = features(spark).select("feature_idx", "chr", "bp", "snp_id", (y * y * y).alias("p"))
    again = rows.filter(f % 9 == 0).select((f + N_FEATURES).alias("row_idx"), "chr", "bp", "snp_id", (F.col("p") / 2).alias("p"))
    return rows.withColumnRenamed("feature_idx", "row_idx").unionByName(again)


def reference_sites(spark: SparkSession, af: DataFrame, numeric: bool = False) -> DataFrame:
    """A reference panel: some sites absent, some with swapped or other alleles or another position."""
    f = F.col("feature_idx")
    a, g, t = ("0", "2", "3") if numeric else ("A", "G", "T")
    rows = features(spark).join(af.select("feature_idx", "af"), "feature_idx").filter(f % 7 != 0)
    return rows.select(
        f.alias("ref_idx"),
        "chr",
        "snp_id",
        F.when(f % 11 == 0, F.col("bp") + 5).otherwise(F.col("bp")).alias("bp"),
        F.when(f % 5 == 0, g).otherwise(a).alias("a1"),
        F.when(f % 13 == 0, t).when(f % 5 == 0, a).otherwise(g).alias("a2"),
        "af",
    )


MODEL_S = (8.0, 4.0, 2.0)


def model_v(spark: SparkSession) -> DataFrame:
    """feature_idx, k, v: toy loadings."""
    k = spark.range(3).withColumnRenamed("id", "k")
    v = ((F.col("id") * (F.col("k") + 3)) % 17 - 8).cast("double") / 16
    return spark.range(N_FEATURES).crossJoin(F.broadcast(k)).select(F.col("id").alias("feature_idx"), "k", v.alias("v"))


def model_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, k, u: toy scores."""
    k = spark.range(3).withColumnRenamed("id", "k")
    u = ((F.col("sample_idx") * (F.col("k") + 2)) % 13 - 6).cast("double") / 64
    return samples(spark, sf_dir).crossJoin(F.broadcast(k)).select("sample_idx", "k", u.alias("u"))


# --- the same in SQL ---------------------------------------------------------------------------

SQL = {
    "fx_samples": "SELECT vec_id AS sample_idx, 'L' || label AS fid, 'S' || vec_id AS iid FROM embeddings",
    "fx_features": "SELECT f AS feature_idx, CAST(f // 16 + 1 AS VARCHAR) AS chr, 'rs' || f AS snp_id, 1000 + (f % 16) * 1000 + (f * 37) % 300 AS bp,"
    " 'A' AS a1, 'G' AS a2 FROM (SELECT unnest(range(64)) AS f)",
    "fx_dosage": "SELECT f AS feature_idx, vec_id AS sample_idx, CASE WHEN (vec_id * 7 + f * 13) % 29 = 0 THEN NULL"
    " WHEN x < -0.25::DOUBLE + 0.01::DOUBLE * (f % 32) THEN 0 WHEN x < -0.05::DOUBLE + 0.01::DOUBLE * (f % 32) THEN 1 ELSE 2 END::BIGINT AS dos"
    " FROM (SELECT vec_id, f, embedding[4 * (f // 4) + 1]::DOUBLE + 0.3::DOUBLE * embedding[f + 1]::DOUBLE AS x"
    " FROM embeddings, (SELECT unnest(range(64)) AS f))",
    "fx_af": "SELECT feature_idx, count(dos) AS n, count(*) - count(dos) AS n_missing,"
    " coalesce(sum(dos)::DOUBLE / (2 * count(dos)), 0) AS af FROM fx_dosage GROUP BY feature_idx",
    "fx_gl": "SELECT feature_idx, sample_idx, CASE WHEN dos IS NULL THEN 1.0::DOUBLE / 3.0::DOUBLE WHEN dos = 0 THEN 0.9::DOUBLE ELSE 0.05::DOUBLE END AS p0,"
    " CASE WHEN dos IS NULL THEN 1.0::DOUBLE / 3.0::DOUBLE WHEN dos = 1 THEN 0.9::DOUBLE ELSE 0.05::DOUBLE END AS p1 FROM fx_dosage",
    "fx_counts": "SELECT l_partkey % 200 AS feature_idx, l_suppkey AS sample_idx, sum(l_quantity)::BIGINT AS x FROM lineitem GROUP BY 1, 2",
    "fx_assoc": "SELECT row_idx, chr, bp, snp_id, p FROM (SELECT feature_idx AS row_idx, chr, bp, snp_id, y * y * y AS p, y FROM"
    " (SELECT *, ((feature_idx * 29 + 7) % 64 + 1)::DOUBLE / 64 AS y FROM fx_features)"
    " UNION ALL SELECT feature_idx + 64, chr, bp, snp_id, y * y * y / 2, y FROM"
    " (SELECT *, ((feature_idx * 29 + 7) % 64 + 1)::DOUBLE / 64 AS y FROM fx_features WHERE feature_idx % 9 = 0))",
    "fx_count_features": "SELECT unnest(range(201)) AS feature_idx",
    "fx_count_samples": "SELECT s_suppkey AS sample_idx FROM supplier UNION ALL SELECT -1",
    "fx_refbim": "SELECT feature_idx AS ref_idx, chr, snp_id, CASE WHEN feature_idx % 11 = 0 THEN bp + 5 ELSE bp END AS bp,"
    " CASE WHEN feature_idx % 5 = 0 THEN 'G' ELSE 'A' END AS a1,"
    " CASE WHEN feature_idx % 13 = 0 THEN 'T' WHEN feature_idx % 5 = 0 THEN 'A' ELSE 'G' END AS a2, af"
    " FROM fx_features JOIN fx_af USING (feature_idx) WHERE feature_idx % 7 <> 0",
    "fx_v": "SELECT f AS feature_idx, k, ((f * (k + 3)) % 17 - 8)::DOUBLE / 16 AS v FROM (SELECT unnest(range(64)) AS f), (SELECT unnest(range(3)) AS k)",
    "fx_s": "SELECT * FROM (VALUES (0::BIGINT, 8.0::DOUBLE), (1, 4.0), (2, 2.0)) t(k, s)",
    "fx_u": "SELECT vec_id AS sample_idx, k, ((vec_id * (k + 2)) % 13 - 6)::DOUBLE / 64 AS u FROM embeddings, (SELECT unnest(range(3)) AS k)",
}

_NEEDS = {
    "fx_af": ["fx_dosage"],
    "fx_gl": ["fx_dosage"],
    "fx_assoc": ["fx_features"],
    "fx_refbim": ["fx_features", "fx_af"],
}


def with_views(*names: str, recursive: bool = False, more: str = "") -> str:
    """A WITH clause of the views and what they need, then `more` of the query's own."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([*(f"{n} AS ({SQL[n]})" for n in order), *([more] if more else [])]) + "\n"
