"""Writers. Tables of any size are written by Spark; text of a model's small parts by the driver's Spark."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.operators.frequency import dense_index
from karst.operators.lineage import cut
from karst.operators.matrix import block
from karst.operators.pca import Pca
from karst.operators.permute import band_order
from karst.operators.prefix import running
from karst.operators.tiles import Tiles
from karst.sources import placed
from karst.sources.genotypes import BED_MAGIC, encode_bed


def six(x: float) -> str:
    return f"{x:.6g}"


def _lines(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, value string")
    rows.coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def _tsv(rows: DataFrame, path: str, header: bool = False, compression: str | None = None) -> None:
    w = rows.write.mode("overwrite").option("sep", "\t").option("header", header)
    (w.option("compression", compression) if compression else w).csv(path)


def write_eigs(spark: SparkSession, fit: Pca, prefix: str, ploidy: int = 2, loadings: bool = False) -> None:
    """prefix.sigvals (with `#N,M`), .eigvals (times ploidy), .eigvecs and, if asked for, .loadings."""
    _lines(spark, [f"#{len(fit.u)},{fit.n_features}", *map(six, fit.s)], prefix + ".sigvals")
    _lines(spark, [six(x) for x in fit.eigenvalues(ploidy)], prefix + ".eigvals")
    _lines(spark, ["\t".join(map(six, row)) for row in fit.u], prefix + ".eigvecs")
    if loadings:
        text = F.array_join(F.transform("pcs", lambda x: F.format_string("%.6g", x)), "\t")
        fit.v.repartitionByRange("feature_idx").sortWithinPartitions("feature_idx").select(text.alias("value")).write.mode("overwrite").text(
            prefix + ".loadings"
        )


def write_eigvecs2(spark: SparkSession, samples: DataFrame, u: np.ndarray, path: str) -> None:
    """#FID IID PC1 .. PCk; samples without a family carry 0."""
    people = samples.orderBy("sample_idx").collect()
    head = "\t".join(["#FID", "IID", *[f"PC{i + 1}" for i in range(u.shape[1])]])
    fid = lambda r: r["fid"] if "fid" in r.asDict() else "0"
    _lines(spark, [head, *["\t".join([fid(r), r["iid"], *map(six, row)]) for r, row in zip(people, u)]], path)


def write_sites(sites: DataFrame, af: DataFrame, path: str) -> None:
    """The sites' six columns and the frequency, in the original order, of the features that `af` has."""
    rows = sites.drop("af").join(af.select("feature_idx", "af"), "feature_idx").repartitionByRange("feature_idx").sortWithinPartitions("feature_idx")
    cm = F.col("cm") if "cm" in sites.columns else F.lit(0)
    _tsv(rows.select("chr", "snp_id", cm.alias("cm"), "bp", "a1", "a2", F.format_string("%.6g", "af").alias("af")), path)


def _places(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their place in feature order from 0, and their number."""
    got = rows.agg(F.count(F.lit(1)).alias("m"), F.min("feature_idx").alias("lo"), F.max("feature_idx").alias("hi")).first()
    m = got["m"]
    if not m or got["lo"] == 0 and got["hi"] == m - 1:
        return rows.withColumn("place", F.col("feature_idx")), m
    return rows.join(dense_index(rows.select("feature_idx"), "feature_idx", "place"), "feature_idx"), m


def _write_rows(rows: DataFrame, encode, row_bytes: int, head: bytes, path: str) -> None:
    """A file of a head and rows of equal size; encode(matrix of a batch) gives their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                raw = encode(block(b.column(1)))
                ends = pa.py_buffer(np.arange(len(b) + 1, dtype="<i4") * row_bytes)
                data = pa.Array.from_buffers(pa.binary(), len(b), [None, ends, pa.py_buffer(raw)])
                offset = b.column(0).to_numpy() * row_bytes + len(head)
                yield pa.RecordBatch.from_arrays([pa.array(offset, pa.int64()), data], ["offset", "data"])

    body = rows.mapInArrow(run, placed.SCHEMA)
    top = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("offset"), F.lit(bytearray(head)).alias("data"))
    placed.write_placed(top.unionByName(body), path)


def write_matrix(rows: DataFrame, n: int, path: str) -> None:
    """A features-by-samples matrix as uint32 sizes and float32 rows in feature order: one file, written by all tasks."""
    rows, m = _places(rows)
    _write_rows(rows.select("place", "values"), lambda x: x.astype("<f4").tobytes(), 4 * n, struct.pack("<II", m, n), path)


def _copies(x: np.ndarray) -> bytes:
    return encode_bed(np.where(np.isnan(x), -1, x))


def write_bed(rows: DataFrame, path: str) -> None:
    """feature_idx, dos (array) as a bed file in feature order, written by all tasks."""
    n = (rows.select(F.size("dos").alias("n")).first() or [0])[0]
    rows, _ = _places(rows)
    _write_rows(rows.select("place", "dos"), _copies, -(-n // 4), BED_MAGIC, path)


def write_lines(rows: DataFrame, order: str, path: str) -> None:
    """The text column `value` as lines of one file, in the order of another column."""
    line = rows.select(order, F.concat("value", F.lit("\n")).cast("binary").alias("data"))
    told = running(line, [order], {"offset": F.octet_length("data").cast("long")})
    placed.write_placed(told.select("offset", "data"), path)


def write_permuted(rows: DataFrame, sites: DataFrame, people: DataFrame, prefix: str, bands: int) -> DataFrame:
    """prefix.perm.bed, .bim and .fam: features dealt to `bands` bands, one band after the other. Returns new_pos, feature_idx."""
    order = cut(band_order(sites, bands), "order")
    moved = rows.join(order, "feature_idx").select(F.col("new_pos").alias("feature_idx"), "dos")
    write_bed(moved, prefix + ".perm.bed")
    line = F.col("line") if "line" in sites.columns else F.concat_ws("\t", "chr", "snp_id", F.lit(0), "bp", "a1", "a2")
    write_lines(sites.join(order, "feature_idx").select("new_pos", line.alias("value")), "new_pos", prefix + ".perm.bim")
    person = F.col("line") if "line" in people.columns else F.concat_ws("\t", "fid", "iid", F.lit("0\t0\t0\t-9"))
    write_lines(people.select("sample_idx", person.alias("value")), "sample_idx", prefix + ".perm.fam")
    return order


def write_r2(report: DataFrame, path: str) -> None:
    """Gzipped CHR_A BP_A SNP_A CHR_B BP_B SNP_B R2 with six decimals."""
    names = ["chr_a", "bp_a", "snp_a", "chr_b", "bp_b", "snp_b"]
    cols: list[Column] = [F.col(c).alias(c.upper()) for c in names]
    _tsv(report.select(*cols, F.format_string("%.6f", "r2").alias("R2")), path, header=True, compression="gzip")


def write_prune(sites: DataFrame, kept: DataFrame, prefix: str) -> None:
    """prefix.ld.prune.in and prefix.ld.prune.out: the sites' lines as they were read."""
    line = F.col("line") if "line" in sites.columns else F.concat_ws("\t", "chr", "snp_id", F.lit(0), "bp", "a1", "a2")
    rows = sites.join(kept, "feature_idx").repartitionByRange("feature_idx").sortWithinPartitions("feature_idx")
    for name, which in (("in", F.col("keep")), ("out", ~F.col("keep"))):
        rows.filter(which).select(line.alias("value")).write.mode("overwrite").text(f"{prefix}.ld.prune.{name}")


def write_clumps(clumps: DataFrame, assoc: DataFrame, prefix: str, header: str, phenotype: int = 0) -> None:
    """prefix.p{i}.clump: the table's header and SP2, then each index site's line and the sites that it took, by chromosome and p."""
    first = assoc.groupBy("chr", "bp", "p").agg(F.min(F.struct("row_idx", "line")).alias("row"))
    rows = clumps.join(first, ["chr", "bp", "p"]).select("chr", "p", "bp", F.concat_ws("\t", "row.line", "sp2").alias("value"))
    top = rows.sparkSession.createDataFrame([("", 0.0, 0, f"{header}\tSP2")], "chr string, p double, bp long, value string")
    rows = top.withColumn("n", F.lit(0)).unionByName(rows.withColumn("n", F.lit(1)))
    rows.repartitionByRange("n", "chr", "p", "bp").sortWithinPartitions("n", "chr", "p", "bp").select("value").write.mode("overwrite").text(
        f"{prefix}.p{phenotype}.clump"
    )


def write_hwe(table: DataFrame, sites: DataFrame, path: str) -> None:
    """#ID HWE_P LRT Inbreeding_coefficient."""
    rows = table.join(sites.select("feature_idx", "snp_id"), "feature_idx").repartitionByRange("feature_idx").sortWithinPartitions("feature_idx")
    _tsv(rows.select(F.col("snp_id").alias("#ID"), F.col("p").alias("HWE_P"), F.col("lrt").alias("LRT"), F.col("f").alias("Inbreeding_coefficient")), path, header=True)


def write_covariance(cov: Tiles, path: str) -> None:
    text = F.array_join(F.transform("values", lambda x: F.format_string("%.6g", x)), "\t")
    cov.lines().repartitionByRange("i").sortWithinPartitions("i").select(text.alias("value")).write.mode("overwrite").text(path)


def zstd_compress(source: str, target: str, level: int = 3) -> None:
    import zstandard

    with open(source, "rb") as a, open(target, "wb") as b:
        zstandard.ZstdCompressor(level=level).copy_stream(a, b)
