"""Readers of plain matrices, saved models and association tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from karst.sources.genotypes import _ranges, numbered, open_binary

#: Fixed value: the first bytes of a zstd frame.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def is_zstd(path: str) -> bool:
    with open_binary(path) as f:
        return f.read(4) == ZSTD_MAGIC


def read_csv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """feature_idx, values of a comma-separated matrix without a header, features by samples (plain, .gz or .zst).

    Rows of unequal length and empty files are errors.
    """
    rows = numbered(spark, path, "feature_idx").select("feature_idx", F.split("value", ",").alias("x"))
    got = rows.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    if got["lo"] is None:
        raise ValueError("the file is empty")
    if got["lo"] != got["hi"]:
        raise ValueError(f"rows of {got['lo']} and of {got['hi']} columns")
    return rows.select("feature_idx", F.transform("x", lambda c: c.cast("float").cast("double")).alias("values"))


def csv_cells(rows: DataFrame) -> DataFrame:
    """Long form of a count matrix, zeros left out; csv_axes tells the features and samples that may have no cell."""
    x = rows.select("feature_idx", F.posexplode("values").alias("sample_idx", "x")).filter("x <> 0")
    return x.select("feature_idx", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("x"))


def csv_axes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All features and all samples of a count matrix."""
    n = rows.agg(F.max(F.size("values"))).first()[0] or 0
    return rows.select("feature_idx"), rows.sparkSession.range(n).select(F.col("id").alias("sample_idx"))


class _BinReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with open_binary(self.path) as f:
            head = f.read(8)
        if head[:4] == ZSTD_MAGIC:
            raise ValueError("compressed binary matrices aren't supported")
        m, n = struct.unpack("<II", head)
        parts = _ranges(m, 4 * n)
        for p in parts:
            p.offset = n
        return parts

    def read(self, part) -> Iterator[pa.RecordBatch]:
        n = part.offset
        with open_binary(self.path) as f:
            f.seek(8 + 4 * n * part.first)
            raw = f.read(4 * n * (part.last - part.first))
        x = np.frombuffer(raw, "<f4").reshape(-1, n).astype(float)
        x = x - x.mean(1, keepdims=True)
        offsets = pa.array(np.arange(len(x) + 1) * n, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(part.first, part.first + len(x)), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))],
            ["feature_idx", "values"],
        )


class BinSource(DataSource):
    """uint32 features, uint32 samples, then float32 rows; each row comes without its mean."""

    @classmethod
    def name(cls) -> str:
        return "karst_bin"

    def schema(self) -> str:
        return "feature_idx long, values array<double>"

    def reader(self, schema):
        return _BinReader(self.options["path"])


def read_bin(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BinSource)
    return spark.read.format("karst_bin").load(path)


def read_sigvals(spark: SparkSession, path: str) -> tuple[int, int, np.ndarray]:
    """Samples, features and singular values: a line `#N,M`, then a number a line."""
    lines = [r["value"] for r in numbered(spark, path, "line").orderBy("line").collect()]
    n, m = (int(x) for x in lines[0].lstrip("#").split(","))
    return n, m, np.array([float(x) for x in lines[1:]])


def read_eigvals(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([float(r["value"]) for r in numbered(spark, path, "line").orderBy("line").collect()])


def read_table(spark: SparkSession, path: str, key: str, k: int | None = None) -> DataFrame:
    """Rows of a tab-separated table of numbers: `key`, pcs. Lines starting with # are left out; a row of another width than k is an error."""
    rows = numbered(spark, path, key, ~F.col("value").startswith("#")).select(key, F.transform(F.split(F.trim("value"), r"[ \t]+"), lambda c: c.cast("double")).alias("pcs"))
    got = rows.agg(F.min(F.size("pcs")).alias("lo"), F.max(F.size("pcs")).alias("hi")).first()
    if got["lo"] != got["hi"] or k is not None and got["lo"] not in (None, k):
        raise ValueError(f"{path} has rows of {got['lo']} to {got['hi']} numbers")
    return rows


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """feature_idx, af: the seventh of exactly seven tab-separated columns."""
    rows = numbered(spark, path, "feature_idx").select("feature_idx", F.split("value", "\t").alias("x"))
    if rows.filter(F.size("x") != 7).limit(1).count():
        raise ValueError(f"{path} needs seven columns")
    return rows.select("feature_idx", F.get("x", F.lit(6)).cast("double").alias("af"))


def read_model(spark: SparkSession, prefix: str) -> dict[str, object]:
    """u, s, v, af of a saved model (prefix.eigvecs, .sigvals, .loadings, .mbim)."""
    n, m, s = read_sigvals(spark, prefix + ".sigvals")
    u = read_table(spark, prefix + ".eigvecs", "sample_idx")
    v = read_table(spark, prefix + ".loadings", "feature_idx")
    return {"n": n, "m": m, "s": s, "u": u, "v": v, "af": read_frequencies(spark, prefix + ".mbim")}


def read_assoc(spark: SparkSession, path: str, names: tuple[str, str, str] = ("CHR", "BP", "P")) -> DataFrame:
    """row_idx, chr, bp, p, line of a tab-separated table; its column names are a parameter, and each must be there."""
    lines = numbered(spark, path, "row_idx")
    head = assoc_header(spark, path).split("\t")
    missing = [c for c in names if c not in head]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    x = F.split("value", "\t")
    at = [F.get(x, F.lit(head.index(c))) for c in names]
    return lines.filter("row_idx > 0").select(
        "row_idx", at[0].alias("chr"), at[1].try_cast("long").alias("bp"), at[2].try_cast("double").alias("p"), F.col("value").alias("line")
    )


def assoc_header(spark: SparkSession, path: str) -> str:
    """The first line of a table."""
    return numbered(spark, path, "row_idx").filter("row_idx = 0").first()["value"]


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
