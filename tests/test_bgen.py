import json
import struct
import zlib

import numpy as np
import pytest

from karst.cli import main
from karst.sources import bgen


def record(name, pos, data, layout=2, n=0, alleles=(b"A", b"G"), told=True):
    """A variant's bytes; `data` as it stands in the file, after its length if `told`."""
    out = struct.pack("<I", n) if layout == 1 else b""
    out += b"".join(struct.pack("<H", len(t)) + t for t in (b"v", name, b"1")) + struct.pack("<I", pos)
    out += struct.pack("<H", len(alleles)) if layout == 2 else b""
    out += b"".join(struct.pack("<I", len(a)) + a for a in alleles)
    return out + (struct.pack("<I", len(data)) if told else b"") + data


def body(q, ploidy=None, gone=(), phased=0):
    """Data of layout 2 in 8 bits: q, the stored numbers of all samples, one after another."""
    ploidy = [2] * (len(q) // 2) if ploidy is None else ploidy
    flags = bytes(p | (128 if i in gone else 0) for i, p in enumerate(ploidy))
    return struct.pack("<IHBB", len(ploidy), 2, min(ploidy), max(ploidy)) + flags + bytes([phased, 8]) + bytes(q)


def packed(raw, compression):
    if not compression:
        return raw
    import zstandard

    return struct.pack("<I", len(raw)) + (zlib.compress(raw) if compression == 1 else zstandard.compress(raw))


def write(path, records, n, flags, m=None):
    head = struct.pack("<IIII", 20, 20, len(records) if m is None else m, n) + b"bgen" + struct.pack("<I", flags)
    path.write_bytes(head + b"".join(records))
    return str(path)


def walk(records):
    """Places of the variants, by adding up what was written."""
    return [24 + sum(map(len, records[:i])) for i in range(len(records))]


@pytest.mark.parametrize("compression", [0, 1, 2])
def test_ranges_are_those_of_a_walk(spark, tmp_path, compression):
    rng = np.random.default_rng(compression)
    n, m = 60, 120
    q = rng.integers(0, 128, (m, 2 * n))
    records = [record(b"rs%d" % j, j, packed(body(q[j].tolist()), compression), alleles=(b"A", b"G" * (1 + j % 40))) for j in range(m)]
    path = write(tmp_path / "x.bgen", records, n, compression | 2 << 2)
    for scan_bytes in (37, 1000, 5000):
        if scan_bytes == 37 and compression:
            continue
        places = walk(records)
        _, ranges = bgen.bgen_ranges(spark, path, scan_bytes)
        assert [r[0] for r in ranges] == [0] + [r[1] for r in ranges[:-1]] and ranges[-1][1] == m
        assert all(places[first] == place for first, _, place in ranges)
        assert len(ranges) > 1
    rows = bgen.read_bgen(spark, path, scan_bytes=1000).orderBy("feature_idx").collect()
    assert [(r["snp_id"], r["bp"], len(r["a2"])) for r in rows] == [(f"rs{j}", j, 1 + j % 40) for j in range(m)]
    assert np.allclose([r["p0"] for r in rows], q[:, ::2] / 255)


def test_bytes_that_look_like_a_variant(spark, tmp_path):
    n, m = 100, 10
    fake = record(b"rs", 7, struct.pack("<I", n) + b"????")
    q = (fake + bytes(200 - len(fake)))[:200]
    records = [record(b"rs%d" % j, j, body(list(q))) for j in range(m)]
    path = write(tmp_path / "x.bgen", records, n, 2 << 2)
    with bgen.open_binary(path) as f:
        h = bgen.BgenHeader(f)
        inside = walk(records)[0] + len(records[0]) - 200
        assert bgen._first_variant(f, h, inside - 5, h.end) == inside
    _, ranges = bgen.bgen_ranges(spark, path, 450)
    assert ranges[-1][1] == m and {r[2] for r in ranges} <= set(walk(records))


def test_first_layout(spark, tmp_path):
    for compression in (0, 1):
        x = np.array([[[32768, 0, 0], [16384, 16384, 0], [0, 0, 0]], [[0, 0, 32768], [0, 32768, 0], [8192, 8192, 16384]]], "<u2")
        data = [zlib.compress(v.tobytes()) if compression else v.tobytes() for v in x]
        records = [record(b"rs%d" % j, j, d, 1, 3, told=bool(compression)) for j, d in enumerate(data)]
        path = write(tmp_path / f"{compression}.bgen", records, 3, compression | 1 << 2)
        rows = bgen.read_bgen(spark, path, scan_bytes=40).orderBy("feature_idx").collect()
        assert [r["p0"] for r in rows] == [[1, 0.5, None], [0, 0, 0.25]]
        assert [r["p1"] for r in rows] == [[0, 0.5, None], [0, 1, 0.25]]
        # the minor allele's dosage
        assert [r["dosage"] for r in rows] == [[0, 0.5, None], [0, 1, 0.75]]


def test_samples_of_one_copy_beside_two():
    # samples: one copy, two, one copy missing, two
    q = [255, 51, 102, 0, 0, 255]
    p = bgen.decode_bgen(body(q, [1, 2, 1, 2], gone=(2,)), 0)
    assert np.allclose(p[[0, 1, 3]], [[1, 0, 0], [0.2, 0.4, 0.4], [0, 1, 0]]) and np.isnan(p[2]).all()
    p = bgen.decode_bgen(body(q, [1, 2, 1, 2], phased=1), 0)
    assert np.allclose(p[1], [0.08, 0.2 * 0.6 + 0.4 * 0.8, 0.48]) and np.allclose(p[2], [0, 0, 1])
    with pytest.raises(ValueError, match="ploidy"):
        bgen.decode_bgen(body([1, 2, 3], [3]), 0)


def test_index_beside_the_file(spark, tmp_path):
    records = [record(b"rs%d" % j, j, body([j, 9])) for j in range(5)]
    path, index = write(tmp_path / "x.bgen", records, 1, 2 << 2), str(tmp_path / "x.ranges")
    first = bgen.read_bgen(spark, path, index, 50).orderBy("feature_idx").collect()
    kept = json.load(open(index))
    assert [r[2] for r in kept["ranges"]] and kept["size"] == 24 + sum(map(len, records))
    # the stored ranges are what is read
    json.dump({**kept, "ranges": [[0, 2, 24]]}, open(index, "w"))
    assert bgen.read_bgen(spark, path, index).orderBy("feature_idx").collect() == first[:2]
    # another size: found anew
    write(tmp_path / "x.bgen", records[:3], 1, 2 << 2)
    assert bgen.read_bgen(spark, path, index).count() == 3


def test_files_that_are_not_whole(spark, tmp_path):
    records = [record(b"rs%d" % j, j, body([j, 9])) for j in range(5)]
    with pytest.raises(ValueError, match="its header tells 6"):
        bgen.bgen_ranges(spark, write(tmp_path / "a.bgen", records, 1, 2 << 2, 6))
    with pytest.raises(Exception, match="no whole variant"):
        bgen.bgen_ranges(spark, write(tmp_path / "b.bgen", [*records[:4], records[4][:-3]], 1, 2 << 2))
    assert bgen.read_bgen(spark, write(tmp_path / "c.bgen", [], 1, 2 << 2)).count() == 0
    three = [record(b"rs", 1, body([1, 9]), alleles=(b"A", b"C", b"G"))]
    with pytest.raises(Exception, match="3 alleles"):
        bgen.read_bgen(spark, write(tmp_path / "d.bgen", three, 1, 2 << 2)).count()


def test_pca_of_a_file(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, m = 20, 40
    copies = rng.integers(0, 3, (m, n))
    q = np.stack([(copies == 2) * 255, (copies == 1) * 255], 2).reshape(m, -1)
    path = write(tmp_path / "x.bgen", [record(b"rs%d" % j, j, packed(body(q[j].tolist()), 2)) for j in range(m)], n, 2 | 2 << 2)
    out = str(tmp_path / "out")
    main(["-g", path, "-d", "3", "-k", "3", "-C", "0", "-v", "0", "-o", out])
    x = copies / 2 - copies.mean(1, keepdims=True) / 2
    got = sorted((float(r["value"]) for r in spark.read.text(out + ".sigvals").filter("value not like '#%'").collect()), reverse=True)
    assert np.allclose(got, np.linalg.svd(x)[1][:3], rtol=1e-4)
