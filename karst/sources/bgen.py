"""Reader of BGEN files, layouts 1 and 2, by ranges of variants.

A BGEN file has no table of its variants: each tells its own length only. The file is cut into equal
pieces; a task looks for a place in its piece where a variant can begin and follows the lengths from
there to the piece's end. The pieces are true if each ends where the next begins, as the first begins
at a known place; a piece that doesn't fit is followed again from where it has to begin. So the driver
reads the header and holds a place for each RANGE_BYTES of the file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from karst.sources.genotypes import RANGE_BYTES, open_binary

BATCH_CELLS = 1 << 19
#: Bytes of the file that a task follows to find the ranges.
SCAN_BYTES = 64 << 20
#: Longest name or allele at a place where a variant is guessed to begin, and anywhere.
GUESSED, LONGEST = 1 << 12, 1 << 24
BLOCK = 1 << 18
#: The first bytes of zlib and zstd streams.
STREAMS = {1: b"\x78", 2: b"\x28\xb5\x2f\xfd"}


class BgenHeader:
    """The header block of a BGEN file."""

    def __init__(self, f):
        self.end = f.size()
        self.offset, size, self.m, self.n = struct.unpack("<IIII", f.read(16))
        if f.read(4) not in (b"bgen", b"\0\0\0\0"):
            raise ValueError("no BGEN file")
        f.read(size - 20)
        flags = struct.unpack("<I", f.read(4))[0]
        self.compression, self.layout = flags & 3, flags >> 2 & 15
        self.first = self.offset + 4
        if self.layout not in (1, 2) or self.compression > self.layout:
            raise ValueError(f"layout {self.layout} with compression {self.compression} is not defined")


def _fields(buf: bytes, at: int, h: BgenHeader, longest: int) -> tuple[list[bytes], int, int, int] | None:
    """Names and alleles, position, place and length of the data of the variant at `at` of buf.

    None if a length is over `longest`; struct.error if buf ends before the data.
    """
    at += 4 if h.layout == 1 else 0
    texts: list[bytes] = []
    left, pos = 3, 0
    while left:
        wide = len(texts) >= 3
        (n,) = struct.unpack_from("<I" if wide else "<H", buf, at)
        at += 4 if wide else 2
        if n > longest:
            return None
        if at + n > len(buf):
            raise struct.error
        texts.append(buf[at : at + n])
        at, left = at + n, left - 1
        if len(texts) == 3:
            (pos,) = struct.unpack_from("<I", buf, at)
            left = 2
            if h.layout == 2:
                (left,) = struct.unpack_from("<H", buf, at + 4)
            at += 4 if h.layout == 1 else 6
    if h.layout == 1 and not h.compression:
        return texts, pos, at, 6 * h.n
    (size,) = struct.unpack_from("<I", buf, at)
    return texts, pos, at + 4, size


def _record(f, at: int, h: BgenHeader) -> tuple[list[bytes], int, int, int]:
    """`_fields` of the variant at `at` of the file."""
    width = 1 << 12
    while True:
        f.seek(at)
        buf = f.read(width)
        try:
            got = _fields(buf, 0, h, LONGEST)
        except struct.error:
            if at + width < h.end:
                width *= 8
                continue
            got = None
        if got is None or at + got[2] + got[3] > h.end:
            raise ValueError(f"no whole variant at byte {at}")
        return got[0], got[1], at + got[2], got[3]


def _can_begin(buf: bytes, at: int, h: BgenHeader, left: int) -> bool:
    """If the bytes at `at` of buf read as a variant that ends within `left` bytes of the buffer's start."""
    try:
        got = _fields(buf, at, h, GUESSED)
        if got is None:
            return False
        texts, _, data, size = got
        told = struct.unpack_from("<I", buf, at if h.layout == 1 else data)[0]
    except struct.error:
        return False
    if not 0 < size <= left - data or any(min(t, default=32) < 32 for t in texts):
        return False
    if (h.layout == 1 or not h.compression) and told != h.n:
        return False
    head = data + (4 if h.layout == 2 else 0)
    return not h.compression or buf.startswith(STREAMS[h.compression], head)


def _first_variant(f, h: BgenHeader, lo: int, hi: int) -> int | None:
    """The first place from lo on, before hi, where a variant can begin."""
    for base in range(lo, hi, BLOCK):
        f.seek(base)
        buf = f.read(BLOCK + 8 * GUESSED)
        for at in range(min(BLOCK, hi - base, len(buf))):
            if _can_begin(buf, at, h, h.end - base):
                return base + at
    return None


def follow(path: str, h: BgenHeader, lo: int, hi: int, start: int | None = None) -> tuple[int, int, list[int], list[int]] | None:
    """Where the first variant of a piece of the file begins and the last one ends, and the places and
    counts of its ranges. Without `start` the begin is guessed; None if there is none, or a wrong one."""
    with open_binary(path) as f:
        at = _first_variant(f, h, lo, hi) if start is None else start
        if at is None:
            return None
        first, places, counts = at, [], []
        try:
            while at < hi:
                if not places or at - places[-1] >= RANGE_BYTES:
                    places.append(at)
                    counts.append(0)
                counts[-1] += 1
                _, _, data, size = _record(f, at, h)
                at = data + size
        except ValueError:
            if start is not None:
                raise
            return None
        return first, at, places, counts


def bgen_ranges(spark: SparkSession, path: str, scan_bytes: int = SCAN_BYTES) -> tuple[BgenHeader, list[list[int]]]:
    """The header, and (first variant, variant behind the last, place) of ranges of about RANGE_BYTES.

    ValueError if the variants don't end with the file, or are not as many as the header tells.
    """
    with open_binary(path) as f:
        h = BgenHeader(f)
    pieces = [(i, lo, min(lo + scan_bytes, h.end)) for i, lo in enumerate(range(h.first, h.end, scan_bytes))]
    found: dict[int, tuple] = {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                got = follow(path, h, r.lo, r.hi, None if r.start < 0 else r.start)
                if got:
                    yield pd.DataFrame([(r.i, *got)], columns=["i", "first", "stop", "places", "counts"])

    todo = [(i, lo, hi, lo if i == 0 else -1) for i, lo, hi in pieces]
    while todo:
        asked = spark.createDataFrame(todo, "i long, lo long, hi long, start long").repartition(len(todo), "i")
        rows = asked.mapInPandas(run, "i long, first long, stop long, places array<bigint>, counts array<bigint>").collect()
        found.update({r["i"]: r for r in rows})
        # the first piece that doesn't begin where the one before ends is followed again
        at, todo, chain = h.first, [], []
        for i, lo, hi in pieces:
            if at >= hi:
                continue
            if i not in found or found[i]["first"] != at:
                todo = [(i, lo, hi, at)]
                break
            chain.append(found[i])
            at = found[i]["stop"]
    out, n = [], 0
    for piece in chain if pieces else []:
        for place, count in zip(piece["places"], piece["counts"]):
            out.append([n, n + count, place])
            n += count
    if n != h.m:
        raise ValueError(f"{path} has {n} variants, its header tells {h.m}")
    return h, out


def _unpacked(raw: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        return zlib.decompress(raw)
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)


def decode_first_layout(raw: bytes, compression: int) -> np.ndarray:
    """As decode_bgen, of a variant of layout 1: three numbers of 16 bits a sample, 32768 for 1; all 0 is missing."""
    x = np.frombuffer(zlib.decompress(raw) if compression else raw, "<u2").reshape(-1, 3) / 32768
    total = x.sum(1, keepdims=True)
    # rounding leaves sums that aren't 1
    return np.where(total > 0, x / np.where(total > 0, total, 1), np.nan)


def decode_bgen(raw: bytes, compression: int) -> np.ndarray:
    """Probabilities of 2, 1 and 0 copies of the first allele per sample (nan where missing), layout 2.

    A sample of ploidy 1 has 2 copies or none, by the probability of its allele. More alleles than two, and
    other ploidies, are an error.
    """
    if compression:
        raw = _unpacked(raw[4:], compression, struct.unpack_from("<I", raw)[0])
    n, alleles, low, high = struct.unpack_from("<IHBB", raw)
    if alleles != 2 or low < 1 or high > 2:
        raise ValueError("only variants of two alleles and samples of ploidy 1 or 2 are supported")
    told = np.frombuffer(raw, np.uint8, n, 8)
    ploidy, gone = (told & 63).astype(int), told >= 128
    phased, bits = raw[8 + n], raw[9 + n]
    # a probability for each allele of a sample but the last, or for each genotype but the last
    ends = np.cumsum(ploidy)
    values = int(ends[-1]) if n else 0
    if bits in (8, 16, 32):
        x = np.frombuffer(raw, f"<u{bits // 8}", values, 10 + n).astype(float)
    else:
        plain = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 10 + n), bitorder="little")
        x = plain[: values * bits].reshape(-1, bits) @ (2.0 ** np.arange(bits))
    x = np.append(x / (2**bits - 1), 0)
    a, b = x[ends - ploidy], x[ends - 1]
    if phased:
        out = np.stack([a * b, a * (1 - b) + b * (1 - a), (1 - a) * (1 - b)], 1)
    else:
        out = np.column_stack([a, b, np.maximum(0, 1 - a - b)])
    single = ploidy == 1
    out[single] = np.column_stack([a, np.zeros(n), 1 - a])[single]
    out[gone] = np.nan
    return out


class _Variants(InputPartition):
    def __init__(self, first: int, last: int, place: int):
        self.first, self.last, self.place = first, last, place


class _BgenReader(DataSourceReader):
    def __init__(self, path: str, ranges: str):
        self.path, self.ranges = path, ranges

    def partitions(self):
        return [_Variants(*r) for r in json.loads(self.ranges)] or [_Variants(0, 0, 0)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        names = ["feature_idx", "chr", "snp_id", "bp", "a1", "a2", "dosage", "p0", "p1"]

        def batch(sites: list[tuple], p: np.ndarray) -> pa.RecordBatch:
            """A batch of variants; p: variants x samples x 3."""
            gone = np.isnan(p[:, :, 0])
            dose = 2 * p[:, :, 0] + p[:, :, 1]
            # the minor allele's dosage
            flip = np.nansum(dose, 1) > (~gone).sum(1)
            dose = np.where(flip[:, None], 2 - dose, dose)
            ends = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
            array = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.ravel(), mask=gone.ravel()))
            cols = list(zip(*sites))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            flat = [pa.array(list(c), k) for c, k in zip(cols, kinds)]
            return pa.RecordBatch.from_arrays([*flat, array(dose), array(p[:, :, 0]), array(p[:, :, 1])], names)

        with open_binary(self.path) as f:
            h = BgenHeader(f)
            decode = decode_first_layout if h.layout == 1 else decode_bgen
            at, sites, held, cells = part.place, [], [], 0
            for i in range(part.first, part.last):
                texts, pos, data, size = _record(f, at, h)
                if len(texts) != 5:
                    raise ValueError(f"variant {i} has {len(texts) - 3} alleles; two are supported")
                own, rsid, chr_, a1, a2 = (t.decode() for t in texts)
                f.seek(data)
                held.append(decode(f.read(size), h.compression))
                at = data + size
                sites.append((i, chr_, rsid or own, pos, a1, a2))
                cells += len(held[-1])
                if cells >= BATCH_CELLS:
                    yield batch(sites, np.stack(held))
                    sites, held, cells = [], [], 0
            if held:
                yield batch(sites, np.stack(held))


class BgenSource(DataSource):
    """Options: path, ranges (bgen_ranges as JSON). Rows: feature_idx, chr, snp_id, bp, a1, a2, dosage (0 to 2,
    minor allele, null where missing), p0, p1."""

    @classmethod
    def name(cls) -> str:
        return "karst_bgen"

    def schema(self) -> str:
        return "feature_idx long, chr string, snp_id string, bp long, a1 string, a2 string, dosage array<double>, p0 array<double>, p1 array<double>"

    def reader(self, schema):
        return _BgenReader(self.options["path"], self.options["ranges"])


def _kept_ranges(path: str, size: int) -> list[list[int]] | None:
    """Ranges that were stored for a file of this size; None if there are none."""
    try:
        with open_binary(path) as f:
            kept = json.loads(f.read())
    except FileNotFoundError:
        return None
    return kept["ranges"] if kept["size"] == size else None


def read_bgen(spark: SparkSession, path: str, index: str | None = None, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """The variants of a BGEN file (see BgenSource).

    `index` names a file for the places of the ranges: they are read from it where it belongs to a file of
    this size, else found and written to it. A file that was changed but kept its size needs another index.
    """
    spark.dataSource.register(BgenSource)
    ranges = None
    if index:
        with open_binary(path) as f:
            size = f.size()
        ranges = _kept_ranges(index, size)
    if ranges is None:
        h, ranges = bgen_ranges(spark, path, scan_bytes)
        if index:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(index) if "://" in index else (fs.LocalFileSystem(), index.removeprefix("file:"))
            with store.open_output_stream(inner) as out:
                out.write(json.dumps({"size": h.end, "ranges": ranges}).encode())
    return spark.read.format("karst_bgen").option("ranges", json.dumps(ranges)).load(path)


def bgen_likelihoods(rows: DataFrame) -> DataFrame:
    """feature_idx, p0, p1 (arrays) of read_bgen's rows; 0.333333 each where missing."""
    filled = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit(0.333333)))
    return rows.select("feature_idx", filled("p0").alias("p0"), filled("p1").alias("p1"))
