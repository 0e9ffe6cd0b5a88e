"""Scaling of rows of arrays, windows in buckets, decay by ranges and orders of chromosomes, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.operators import ld, ldstats, scaling


@pytest.mark.parametrize("method", [0, 1, 2, 3, 4])
def test_scaled_rows(spark, method):
    rng = np.random.default_rng(method)
    x = rng.poisson(1.3, (40, 9)).astype(float)
    x[4], x[7] = 0, 3
    x[:, 5] = 0  # a sample without counts
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "feature_idx long, values array<double>").repartition(4)
    got = np.array([r["values"] for r in scaling.scaled_rows(rows, 9, method, 100.0).orderBy("feature_idx").collect()])
    cells = spark.createDataFrame([(int(i), int(j), int(x[i, j])) for i, j in zip(*np.nonzero(x))], "feature_idx long, sample_idx long, x long")
    axes = spark.range(40).select(F.col("id").alias("feature_idx")), spark.range(9).select(F.col("id").alias("sample_idx"))
    told = np.zeros((40, 9))
    for r in scaling.scaled(cells, axes[1], method, 100.0, features=axes[0]).collect():
        told[r["feature_idx"], r["sample_idx"]] = r["x"]
    assert np.allclose(got, told)
    assert scaling.scaled_rows(rows.limit(0), 9, method).count() == 0
    with pytest.raises(ValueError):
        scaling.scaled_rows(rows, 9, 5)


@pytest.mark.parametrize("ld_bp", [0, 7, 50, 10_000])
def test_window_sizes(spark, ld_bp):
    rng = np.random.default_rng(ld_bp)
    sites = sorted((c, int(b)) for c in "123" for b in rng.integers(1, 300, 60)) + [("4", 5)]
    df = spark.createDataFrame([(i, c, b) for i, (c, b) in enumerate(sites)], "feature_idx long, chr string, bp long").repartition(5)
    own = {}
    for i, (c, b) in enumerate(sites):
        if any(x == c for x, _ in sites[i + 1 :]):
            own[i] = sum(x == c and y - b <= ld_bp for x, y in sites[i:])
    assert {r["feature_idx"]: r["n_sites"] for r in ld.window_sizes(df, ld_bp).collect()} == own


def test_decay_of_one_distance(spark):
    """All pairs at one distance: the bins are told by the ties alone."""
    rng = np.random.default_rng(1)
    rows = [("1" if i % 3 else "2", i, i + 10, float(v)) for i, v in enumerate(rng.random(200))]
    df = spark.createDataFrame(rows, "chr_a string, bp_a long, bp_b long, r2 double").repartition(6)
    got = {(r["chr"], r["distance"]): r for r in ldstats.decay(df, 80, 8).collect()}
    for c in "12":
        own = np.array_split(sorted(v for x, _, _, v in rows if x == c), 8)
        for k, part in enumerate(own):
            r = got[c, 10.0 * (k + 1)]
            assert r["num"] == len(part) and r["avg_r2"] == pytest.approx(part.mean()) and r["std"] == pytest.approx(part.std(ddof=1))


def test_order_of_chromosomes(spark):
    sites = spark.createDataFrame([(i, c) for i, c in enumerate("1122337")], "feature_idx long, chr string")
    assoc = lambda text: spark.createDataFrame([(i, c) for i, c in enumerate(text)], "row_idx long, chr string")
    ld.check_same_order(assoc("112399"), sites)
    ld.check_same_order(assoc("12").limit(0), sites)
    with pytest.raises(ValueError, match="chromosome 3 comes before 2"):
        ld.check_same_order(assoc("1322"), sites)
