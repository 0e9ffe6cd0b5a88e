"""Linkage disequilibrium: windows, pairs, pruning and clumping.

Sites are (feature_idx, chr, bp, ...); matrix rows are (feature_idx, values) with one value per
sample, centred, 0 where missing. A pair is (i, k) with i before k on one chromosome and at most
`ld_bp` apart; the reference point of a window is its first site.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.operators.lineage import cut
from karst.operators.matrix import map_arrays

SLICE = 8192
SITES = 1024


def chromosome_runs(sites: DataFrame) -> DataFrame:
    """chr, first_idx, last_idx."""
    return sites.groupBy("chr").agg(F.min("feature_idx").alias("first_idx"), F.max("feature_idx").alias("last_idx"))


def band_pairs(sites: DataFrame, ld_bp: int) -> DataFrame:
    """i, k, chr, bp_i, bp_k: a range self-join through buckets of ld_bp.

    Each site meets its own and the next bucket only, by equality on (chr, bucket), so the join is
    a hash or merge join and its rows are the window pairs and at most as many again.
    """
    width = max(1, ld_bp)
    bucket = F.floor(F.col("bp") / width)
    left = sites.select("chr", F.col("feature_idx").alias("i"), F.col("bp").alias("bp_i"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    right = sites.select("chr", F.col("feature_idx").alias("k"), F.col("bp").alias("bp_k"), bucket.alias("bucket"))
    both = left.join(right, ["chr", "bucket"])
    return both.filter((F.col("i") < F.col("k")) & (F.col("bp_k") - F.col("bp_i") <= ld_bp)).select("i", "k", "chr", "bp_i", "bp_k")


def window_sizes(sites: DataFrame, ld_bp: int) -> DataFrame:
    """feature_idx, n_sites: sites from this one on within ld_bp, itself included; the last of a chromosome leads no window.

    Sites are dealt to buckets of ld_bp positions and lent to the bucket before, whose windows may see them.
    """
    width = max(1, ld_bp)
    own = F.floor(F.col("bp") / width)
    dealt = sites.select("feature_idx", "chr", "bp", own.alias("own"), F.explode(F.array(own, own - 1)).alias("bucket"))
    w = Window.partitionBy("chr", "bucket").orderBy("bp").rangeBetween(0, ld_bp)
    same = Window.partitionBy("chr", "bucket", "bp").orderBy("feature_idx")
    # sites of equal position that come before this one aren't in its window
    sizes = dealt.withColumn("n_sites", F.count(F.lit(1)).over(w) - (F.row_number().over(same) - 1)).filter("own = bucket")
    last = sites.groupBy("chr").agg(F.max("feature_idx").alias("last"))
    return sizes.join(last, "chr").filter(F.col("feature_idx") != F.col("last")).select("feature_idx", "n_sites")


def check_same_order(assoc: DataFrame, sites: DataFrame) -> None:
    """The chromosomes that both tables have must begin in the same order in both."""
    first = assoc.groupBy("chr").agg(F.min("row_idx").alias("a")).join(sites.groupBy("chr").agg(F.min("feature_idx").alias("b")), "chr")
    # a row for each chromosome
    rows = sorted(first.collect(), key=lambda r: r["a"])
    for x, y in zip(rows, rows[1:]):
        if x["b"] > y["b"]:
            raise ValueError(f"chromosome {x['chr']} comes before {y['chr']} in the association table, but after it among the sites")


def to_rows(cells: DataFrame, value: str = "g") -> DataFrame:
    """feature_idx, values: cells of a feature in the order of sample_idx."""
    grouped = cells.groupBy("feature_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", value))).alias("cells"))
    return grouped.select("feature_idx", F.transform("cells", lambda c: c[value]).alias("values"))


def unit_rows(rows: DataFrame) -> DataFrame:
    """Rows of length 1; rows without variance become zeros, so that their r2 is 0."""

    def run(x, _):
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return (x / np.where(norm > 0, norm, np.inf),)

    return map_arrays(rows.select("feature_idx", "values"), run, None, "feature_idx long, values array<double>")


def pair_products(rows: DataFrame, sites: DataFrame, ld_bp: int, slice_: int = SLICE, sites_: int = SITES) -> DataFrame:
    """i, k, r: dot products of the rows of all window pairs, made in dense blocks.

    Rows are dealt by (chr, bucket, slice of samples, pair of blocks of sites); a group multiplies the
    sites of a block of its bucket with those of a block of that or of the next one, in numpy. Products
    add up over slices, so a group holds two blocks of `sites_` sites times `slice_` samples, whatever
    the number of samples and however dense a region or wide a window is.
    """
    width = max(1, ld_bp)
    bucket = F.floor(F.col("bp") / width)
    own = sites.select("feature_idx", "chr", "bp", bucket.alias("bucket"))
    # a site's block within its bucket, and how many blocks the bucket and the next one have
    rank = F.row_number().over(Window.partitionBy("chr", "bucket").orderBy("feature_idx")) - 1
    own = own.withColumn("block", F.floor(rank / sites_).cast("int"))
    sizes = own.groupBy("chr", "bucket").agg((F.max("block") + 1).alias("blocks"))
    after = sizes.select("chr", (F.col("bucket") - 1).alias("bucket"), F.col("blocks").alias("next_blocks"))
    before = sizes.select("chr", (F.col("bucket") + 1).alias("bucket"), F.col("blocks").alias("last_blocks"))
    own = own.join(sizes, ["chr", "bucket"]).join(after, ["chr", "bucket"], "left").join(before, ["chr", "bucket"], "left")
    # groups (bucket, x, y): block x of the bucket as leads; y counts its own blocks from x on, then the next bucket's
    lead = F.transform(
        F.sequence(F.col("block"), F.col("blocks") + F.coalesce("next_blocks", F.lit(0)) - 1),
        lambda y: F.struct(F.col("bucket").alias("of"), F.col("block").alias("x"), y.alias("y"), F.lit(True).alias("lead")),
    )
    mate = F.transform(
        F.when(F.col("block") > 0, F.sequence(F.lit(0), F.col("block") - 1)).otherwise(F.array().cast("array<int>")),
        lambda x: F.struct(F.col("bucket").alias("of"), x.alias("x"), F.col("block").alias("y"), F.lit(False).alias("lead")),
    )
    ahead = F.transform(
        F.when(F.col("last_blocks").isNotNull(), F.sequence(F.lit(0), F.col("last_blocks") - 1)).otherwise(F.array().cast("array<int>")),
        lambda x: F.struct((F.col("bucket") - 1).alias("of"), x.alias("x"), (F.col("last_blocks") + F.col("block")).alias("y"), F.lit(False).alias("lead")),
    )
    groups = own.select("feature_idx", "chr", "bp", F.inline(F.concat(lead, mate, ahead)))
    placed = rows.join(groups, "feature_idx")
    n = F.greatest(F.ceil(F.size("values") / F.lit(slice_)), F.lit(1)).cast("int")
    parts = placed.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    dealt = parts.withColumn("values", F.slice("values", F.col("part") * slice_ + 1, F.lit(slice_)))

    def multiply(table: pa.Table) -> pa.Table:
        idx, bp = table.column("feature_idx").to_numpy(), table.column("bp").to_numpy()
        lead = table.column("lead").to_numpy(zero_copy_only=False).astype(bool)
        x = table.column("values").combine_chunks().flatten().to_numpy().reshape(len(idx), -1)
        # leads of a block meet each other in the group of that block with itself
        mates = np.ones(len(idx), bool) if table.column("x")[0].as_py() == table.column("y")[0].as_py() else ~lead
        r = x[lead] @ x[mates].T
        near = (idx[lead][:, None] < idx[mates][None, :]) & (bp[mates][None, :] - bp[lead][:, None] <= ld_bp)
        a, b = np.nonzero(near)
        return pa.table({"i": pa.array(idx[lead][a], pa.int64()), "k": pa.array(idx[mates][b], pa.int64()), "r": pa.array(r[a, b], pa.float64())})

    found = dealt.groupBy("chr", "of", "x", "y", "part").applyInArrow(multiply, "i long, k long, r double")
    return found.groupBy("i", "k").agg(F.sum("r").alias("r"))


def r2_pairs(rows: DataFrame, sites: DataFrame, ld_bp: int) -> DataFrame:
    """i, k, r2 of all window pairs."""
    return pair_products(unit_rows(rows), sites, ld_bp).select("i", "k", (F.col("r") * F.col("r")).alias("r2"))


def r2_report(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """chr_a, bp_a, snp_a, chr_b, bp_b, snp_b, r2."""
    a = sites.select(F.col("feature_idx").alias("i"), F.col("chr").alias("chr_a"), F.col("bp").alias("bp_a"), F.col("snp_id").alias("snp_a"))
    b = sites.select(F.col("feature_idx").alias("k"), F.col("chr").alias("chr_b"), F.col("bp").alias("bp_b"), F.col("snp_id").alias("snp_b"))
    return pairs.join(a, "i").join(b, "k").select("chr_a", "bp_a", "snp_a", "chr_b", "bp_b", "snp_b", "r2")


#: Sites of a range whose links are looked at in one task.
RANGE = 1 << 16


def with_runs(rows: DataFrame, start: str, stop: str) -> DataFrame:
    """Add `run`: rows (chr, start, stop) whose intervals of sites overlap are in one run, named by its least start.

    A run begins where no interval that began before reaches. The furthest stop is found in ranges of
    RANGE sites, and of all ranges before, a row each.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(start) / RANGE))
    tops = ranged.groupBy("chr", "__range").agg(F.max(stop).alias("__far"))
    earlier = Window.partitionBy("chr").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("chr", "__range", F.max("__far").over(earlier).alias("__before"))
    starts = ranged.groupBy("chr", "__range", start).agg(F.max(stop).alias("__own")).join(tops, ["chr", "__range"])
    inside = Window.partitionBy("chr", "__range").orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max("__own").over(inside), F.col("__before"))
    heads = starts.withColumn("__new", reach.isNull() | (reach < F.col(start)))
    heads = heads.withColumn("run", F.max(F.when(F.col("__new"), F.col(start))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a run that goes on from an earlier range has its head there
    last = heads.groupBy("chr", "__range").agg(F.max(F.when(F.col("__new"), F.col(start))).alias("__head"))
    last = last.select("chr", "__range", F.max("__head").over(earlier).alias("__from"))
    named = heads.join(last, ["chr", "__range"]).select("chr", start, F.coalesce("run", "__from").alias("run"))
    return rows.join(named, ["chr", start])


def prune(pairs: DataFrame, sites: DataFrame, cutoff: float) -> DataFrame:
    """feature_idx, keep. Sites lead in order; a dropped site leads no more. For each kept k of the
    window with r2 above the cutoff, k is dropped, unless its minor allele frequency is larger: then
    the lead is dropped, and goes on through its window. Without `af` k is always dropped.

    Only pairs above the cutoff reach the sequential step, which runs once for each run of sites that
    no such pair leaves: what happens in one run cannot change another.
    """
    has_af = "af" in sites.columns
    maf = F.when(F.col("af") > 0.5, 1 - F.col("af")).otherwise(F.col("af")) if has_af else F.lit(0.0)
    told = sites.select("feature_idx", "chr", maf.alias("maf"))
    a = told.select(F.col("feature_idx").alias("i"), "chr", F.col("maf").alias("maf_i"))
    b = told.select(F.col("feature_idx").alias("k"), F.col("maf").alias("maf_k"))
    edges = pairs.filter(F.col("r2") > cutoff).join(a, "i").join(b, "k").select("chr", "i", "k", (F.col("maf_k") > F.col("maf_i")).alias("other"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        dropped: set[int] = set()
        pdf = pdf.sort_values(["i", "k"])
        for i, own in pdf.groupby("i", sort=True):
            if i in dropped:
                continue
            for k, other in zip(own["k"], own["other"]):
                if k not in dropped:
                    dropped.add(i if other else k)
        return pd.DataFrame({"feature_idx": sorted(dropped)}, dtype="int64")

    edges = with_runs(cut(edges, "edges"), "i", "k")
    gone = edges.groupBy("chr", "run").applyInPandas(greedy, "feature_idx long").withColumn("keep", F.lit(False))
    return sites.select("feature_idx").join(gone, "feature_idx", "left").select("feature_idx", F.coalesce("keep", F.lit(True)).alias("keep"))


def first_per_site(assoc: DataFrame, p2: float) -> DataFrame:
    """Association rows with p <= p2, the first of each (chr, bp) by row_idx."""
    w = Window.partitionBy("chr", "bp").orderBy("row_idx")
    return assoc.filter(F.col("p") <= p2).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def clump(pairs: DataFrame, sites: DataFrame, assoc: DataFrame, p1: float, p2: float, r2: float, clump_bp: int) -> DataFrame:
    """chr, bp, p, sp2: index sites by ascending p (ties: bp) with the sites that they take.

    An index site has p <= min(p1, p2) and isn't taken yet; it takes every site with p <= p2, r2 at
    least `r2`, and at most clump_bp away that isn't taken yet. `sp2` lists them by p, or is NONE.
    """
    # of sites that share a position, the last is meant
    own = sites.groupBy("chr", "bp").agg(F.max("feature_idx").alias("feature_idx"))
    hits = first_per_site(assoc, p2).join(own, ["chr", "bp"]).select("chr", "bp", "p", "feature_idx")
    strong = pairs.filter(F.col("r2") >= r2)
    both = strong.select(F.col("i").alias("a"), F.col("k").alias("b")).unionByName(strong.select(F.col("k").alias("a"), F.col("i").alias("b")))
    other = hits.select(F.col("feature_idx").alias("b"), F.col("bp").alias("bp_b"), F.col("p").alias("p_b"))
    near = both.join(other, "b").groupBy("a").agg(
        F.array_sort(F.collect_list(F.struct("p_b", "bp_b", "b"))).alias("near"), F.max("b").alias("top")
    )
    rows = hits.join(near, hits["feature_idx"] == near["a"], "left").select("chr", "bp", "p", "feature_idx", "near", F.greatest("feature_idx", "top").alias("top"))
    # sites that take from each other are in one run; runs are independent
    rows = with_runs(cut(rows, "hits"), "feature_idx", "top")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        for row in pdf.sort_values(["p", "bp"]).itertuples(index=False):
            if row.p > p1 or row.feature_idx in taken:
                continue
            taken.add(row.feature_idx)
            got = []
            for x in row.near if row.near is not None else []:
                if x["b"] not in taken and abs(x["bp_b"] - row.bp) <= clump_bp:
                    taken.add(x["b"])
                    got.append(str(x["bp_b"]))
            out.append((row.chr, row.bp, row.p, ",".join(got) or "NONE"))
        return pd.DataFrame(out, columns=["chr", "bp", "p", "sp2"])

    return rows.groupBy("chr", "run").applyInPandas(greedy, "chr string, bp long, p double, sp2 string")


def _project_batches(u) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = u.value
        for b in batches:
            values = b.column(1)
            x = values.flatten().to_numpy().reshape(len(b), -1)
            x = x - (x @ m) @ m.T
            offsets = pa.array(np.arange(len(b) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["feature_idx", "values"])

    return run


def residual_rows(rows: DataFrame, u: np.ndarray) -> DataFrame:
    """(I - U U') applied to each row; `u` is samples x k, orthonormal, and is broadcast (8 N k bytes)."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(u))
    return rows.select("feature_idx", "values").mapInArrow(_project_batches(shared), "feature_idx long, values array<double>")
