"""Ranks, running sums and windows over the order of all rows, without a window over all rows.

Rows are sorted into ranges and written once. A range's own sums are a small row, of which there are
as many as ranges; sums over the ranges before are added to those inside a range. Windows of a fixed
width go by blocks of ranks, and rows near a block's edge are copied to the neighbours that see them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.operators.lineage import cut

#: Ranks in a block of a window.
BLOCK = 1 << 16


def running(rows: DataFrame, order: Sequence[str], sums: dict[str, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows with `rank` (from 0) and, for each name in `sums`, the sum over the rows before; all within groups of `by`.

    Null values count as nothing. Ties in the order are broken once, as the sorted rows are written.
    """
    keys = [*by, *order]
    given = {**(sums or {}), "rank": F.lit(1).cast("long")}
    sorted_ = rows.withColumns({f"__v_{k}": F.coalesce(v, F.lit(0)) for k, v in given.items()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = cut(sorted_.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranges")
    parts = table.groupBy(*by, "__part").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in given])
    # a row for each range and group of it
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*[F.col(c).alias(f"__b_{c}") for c in (*by, "__part")], *[F.coalesce(F.sum(f"__s_{k}").over(earlier), F.lit(0)).alias(f"__p_{k}") for k in given])
    inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    own = table.withColumns({f"__i_{k}": F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in given})
    on = [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in by] + [F.col("__part") == F.col("__b___part")]
    joined = own.join(before, on)
    return joined.select(*rows.columns, *[(F.col(f"__p_{k}") + F.col(f"__i_{k}")).alias(k) for k in given])


def windowed(rows: DataFrame, rank: str, preceding: int, following: int, made: dict[str, Column], by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Add aggregates over the rows from `preceding` before to `following` after each row, in the order of `rank` (dense, within `by`)."""
    block = max(block, preceding + following + 1)
    r = F.col(rank)
    seen_by = F.sequence(F.floor(F.greatest(r - following, F.lit(0)) / block), F.floor((r + preceding) / block))
    dealt = rows.withColumn("__own", F.floor(r / block)).withColumn("__block", F.explode(seen_by))
    w = Window.partitionBy(*by, "__block").orderBy(rank).rowsBetween(-preceding, following)
    return dealt.withColumns({k: v.over(w) for k, v in made.items()}).filter("__own = __block").drop("__own", "__block")
