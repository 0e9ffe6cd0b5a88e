"""Readers of genotype formats: PLINK bed and BEAGLE; BGEN is in bgen.py.

Each reads in parallel ranges of features. Binary files are read by byte ranges through a Python
data source, so that a task holds a few megabytes of the file whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The first bytes of a SNP-major bed file.
BED_MAGIC = b"\x6c\x1b\x01"
#: Copies of the first allele for the codes 00, 01, 10, 11; -1 is missing.
BED_COPIES = np.array([2, -1, 1, 0], np.int8)
RANGE_BYTES = 4 << 20


def open_binary(path: str):
    """A file of any store that Arrow knows, opened for random access."""
    from pyarrow import fs

    if "://" in path:
        store, inner = fs.FileSystem.from_uri(path)
    elif path.startswith("file:"):
        store, inner = fs.LocalFileSystem(), path.removeprefix("file:")
    else:
        store, inner = fs.LocalFileSystem(), path
    return store.open_input_file(inner)


class _Range(InputPartition):
    def __init__(self, first: int, last: int, offset: int = 0):
        self.first, self.last, self.offset = first, last, offset


def _ranges(n: int, row_bytes: int) -> list[_Range]:
    per = max(1, RANGE_BYTES // max(1, row_bytes))
    return [_Range(i, min(n, i + per)) for i in range(0, n, per)]


def decode_bed(raw: bytes, n_samples: int) -> np.ndarray:
    """Copies of the first allele (-1 missing) of packed rows; four samples a byte, low bits first."""
    packed = np.frombuffer(raw, np.uint8).reshape(-1, -(-n_samples // 4))
    codes = (packed[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return BED_COPIES[codes.reshape(len(packed), -1)[:, :n_samples]]


def encode_bed(copies: np.ndarray) -> bytes:
    """Packed rows of a features-by-samples matrix of copies (-1 missing)."""
    code = np.select([copies == 2, copies == 1, copies == 0], [0, 2, 3], 1).astype(np.uint8)
    pad = np.zeros((len(code), -code.shape[1] % 4), np.uint8)
    quads = np.hstack([code, pad]).reshape(len(code), -1, 4)
    return (quads << np.array([0, 2, 4, 6], np.uint8)).sum(2).astype(np.uint8).tobytes()


class _BedReader(DataSourceReader):
    def __init__(self, path: str, n: int, m: int):
        self.path, self.n, self.m = path, n, m

    def partitions(self):
        with open_binary(self.path) as f:
            if f.read(3) != BED_MAGIC:
                raise ValueError(f"{self.path} is no SNP-major bed file")
        return _ranges(self.m, -(-self.n // 4))

    def read(self, part) -> Iterator[pa.RecordBatch]:
        width = -(-self.n // 4)
        with open_binary(self.path) as f:
            f.seek(3 + part.first * width)
            raw = f.read((part.last - part.first) * width)
        x = decode_bed(raw, self.n)
        offsets = pa.array(np.arange(len(x) + 1) * self.n, pa.int32())
        flat = x.ravel()
        values = pa.array(flat.astype(np.int64), mask=flat < 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(part.first, part.first + len(x)), pa.int64()), pa.ListArray.from_arrays(offsets, values)],
            ["feature_idx", "dos"],
        )


class BedSource(DataSource):
    """Options: path (the .bed), n (samples), m (features). Rows: feature_idx, dos (array, null where missing)."""

    @classmethod
    def name(cls) -> str:
        return "karst_bed"

    def schema(self) -> str:
        return "feature_idx long, dos array<bigint>"

    def reader(self, schema):
        o = self.options
        return _BedReader(o["path"], int(o["n"]), int(o["m"]))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """sample_idx, fid, iid in the order of the file."""
    x = F.split(F.trim("value"), r"[ \t]+")
    return numbered(spark, path, "sample_idx").select(
        "sample_idx", F.get(x, F.lit(0)).alias("fid"), F.get(x, F.lit(1)).alias("iid"), F.col("value").alias("line")
    )


def numbered(spark: SparkSession, path: str, name: str, keep: Column | None = None) -> DataFrame:
    """`name`, value: the lines of a text file, or of a folder's files in the order of their names, numbered from 0.

    Blank lines, and those that `keep` is false for, have no number. Spark reads files in an order of
    its own, so a line's number is its rank in its block of a file, after the lines of the blocks before.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id")
    )
    rows = lines.filter(F.length(F.trim("value")) > 0)
    rows = rows.filter(keep) if keep is not None else rows
    placed = rows.withColumn("__in", F.row_number().over(Window.partitionBy("__file", "__block").orderBy("__id")) - 1)
    sizes = placed.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"))
    # a row per block; part files of one folder have longer names once their numbers have more digits
    order = Window.orderBy(F.length("__file"), "__file", "__block")
    before = sizes.select("__file", "__block", (F.sum("__n").over(order) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), ["__file", "__block"]).select((F.col("__before") + F.col("__in")).alias(name), "value")


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """feature_idx, chr, snp_id, cm, bp, a1, a2, af (null unless the file has a seventh column) and the line itself."""
    x = F.split(F.trim("value"), r"[ \t]+")
    return numbered(spark, path, "feature_idx").select(
        "feature_idx",
        F.get(x, F.lit(0)).alias("chr"),
        F.get(x, F.lit(1)).alias("snp_id"),
        F.get(x, F.lit(2)).cast("double").alias("cm"),
        F.get(x, F.lit(3)).cast("int").alias("bp"),
        F.get(x, F.lit(4)).alias("a1"),
        F.get(x, F.lit(5)).alias("a2"),
        F.get(x, F.lit(6)).cast("double").alias("af"),
        F.col("value").alias("line"),
    )


def check_bim(a: DataFrame, b: DataFrame) -> None:
    """Two site tables must have the same ids in the same order."""
    both = a.select("feature_idx", F.col("snp_id").alias("x")).join(b.select("feature_idx", F.col("snp_id").alias("y")), "feature_idx", "full")
    bad = both.filter(~F.col("x").eqNullSafe(F.col("y"))).limit(1).collect()
    if bad:
        raise ValueError(f"sites differ at {bad[0]['feature_idx']}: {bad[0]['x']} and {bad[0]['y']}")


def read_plink(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dosages (feature_idx, dos: an array over samples), sites and samples of prefix.bed, .bim and .fam."""
    spark.dataSource.register(BedSource)
    sites, people = read_bim(spark, prefix + ".bim"), read_fam(spark, prefix + ".fam")
    n, m = people.count(), sites.count()
    rows = spark.read.format("karst_bed").option("n", n).option("m", m).load(prefix + ".bed")
    return rows, sites, people


def rows_to_long(rows: DataFrame, value: str = "dos") -> DataFrame:
    long_ = rows.select("feature_idx", F.posexplode(value).alias("sample_idx", value))
    return long_.withColumn("sample_idx", F.col("sample_idx").cast("long"))


def rows_to_cells(rows: DataFrame, *names: str) -> DataFrame:
    """Long form of several arrays over samples."""
    x = rows.select("feature_idx", F.posexplode(F.arrays_zip(*names)).alias("sample_idx", "c"))
    return x.select("feature_idx", F.col("sample_idx").cast("long").alias("sample_idx"), *[F.col(f"c.{n}").alias(n) for n in names])


# --- BEAGLE ------------------------------------------------------------------------------------


def read_beagle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Likelihoods (feature_idx, p0, p1: arrays over samples), markers and sample names of a (gzipped) BEAGLE file."""
    lines = numbered(spark, path, "line").withColumn("x", F.split(F.trim("value"), r"[ \t]+"))
    header = lines.filter("line = 0").first()["x"]
    if len(header) % 3:
        raise ValueError("the number of columns must be a multiple of three")
    n = len(header) // 3 - 1
    names = spark.createDataFrame([(i, header[3 + 3 * i]) for i in range(n)], "sample_idx long, iid string")
    body = lines.filter("line > 0").select((F.col("line") - 1).alias("feature_idx"), "x")
    markers = body.select(
        "feature_idx", F.get("x", F.lit(0)).alias("snp_id"), F.get("x", F.lit(1)).alias("a1"), F.get("x", F.lit(2)).alias("a2")
    )
    at = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    gl = body.select(
        "feature_idx",
        F.transform(at, lambda s: F.get("x", 3 + 3 * s).cast("double")).alias("p0"),
        F.transform(at, lambda s: F.get("x", 4 + 3 * s).cast("double")).alias("p1"),
    )
    return gl, markers, names
