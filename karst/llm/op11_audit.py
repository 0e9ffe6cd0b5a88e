"""Interactions of filters: what each order of them removes, by adjacent transpositions.

Each document becomes a bit mask of the filters that it fails. The masks are counted per part in
cells (2^k of them for k filters, three counts each), so documents are read and shuffled once,
whatever the number of orders. The walk over all k! orders goes by plain changes: each order comes
from the one before by a swap of two neighbours. Before and after the two, the set of filters that
ran is the same, so only their two steps are counted anew from the cells. A filter's share
(Shapley, as a sum over all orders) is carried along: when a swap changes what a filter removes, the
old number counts for as many orders as it stood.

The first copy of a text (the smallest doc_id) is found over all parts, by the SHA-256 of the text:
the smallest ids are aggregated before the shuffle and then joined by id, so that no group of
copies comes to one task.

Null texts count as empty, null parts as the empty string. A null doc_id fails no comparison with
others, makes none fail and has no labels. Rows that repeat an id and a text count each, and are no
copies of each other. A document is good (toxic) if any of its label rows says so. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import ASCII_UPPER, cut

WORD = r"[^\x20\x09-\x0D]+"
#: Orders grow as k!, cells as 2^k.
MOST_FILTERS = 8
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, ASCII_UPPER, ""))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(50).cast("long"),
        "C": capitals * F.lit(100).cast("long") > F.char_length(text) * F.lit(3).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each document; bit i stands for the i-th of the filters A to E."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_filters(text).values())]
    sha = F.sha2(text.cast("binary"), 256)
    rows = docs.select(
        # rows without an id meet no other row, each at a place of its own
        F.coalesce(F.col("doc_id").cast("string"), sha).alias("key"),
        F.col("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        sha.alias("sha"),
        sum(bits[1:], bits[0]).alias("mask"),
    )
    rows = cut(rows, "masks")
    # one row for each text, met by id: a group of copies of any size spreads over all partitions
    first = rows.groupBy("sha").agg(F.min("doc_id").cast("string").alias("key")).withColumn("is_first", F.lit(True))
    told = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("key"))
    told = told.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.join(first, ["key", "sha"], "left").join(told, "key", "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return joined.select(
        "part",
        (F.col("mask") + F.when(copy, 1 << len(bits)).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def plain_changes(k: int) -> Iterator[int]:
    """Swaps of places i and i + 1 that lead through all orders of k things, each once."""
    if k < 2:
        return
    inner, downwards = plain_changes(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if downwards else range(k - 1)
        i = next(inner, None)
        if i is None:
            return
        yield i + downwards  # the last thing stands in front now
        downwards = not downwards


class Walk:
    """The orders of one part's filters, from cells: counts by mask of all, good and toxic documents."""

    def __init__(self, names: Sequence[str], total: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        self.names, self.cells = names, (total, good, toxic)
        self.mask = np.arange(1 << len(names))

    def step(self, before: int, f: int) -> tuple[int, ...]:
        """COUNTS of filter f after the filters of the set `before`."""
        total, good, toxic = self.cells
        fails, fresh = (self.mask >> f & 1) == 1, (self.mask & before) == 0
        here = fails & fresh
        found = total[fresh & ~fails], total[here], total[fails & ~fresh], total[self.mask == 1 << f], good[here], toxic[here]
        return tuple(int(x.sum()) for x in found)

    def rows(self) -> Iterator[tuple]:
        """(order, step from 1, COUNTS, the filter's share) of all orders."""
        k = len(self.names)
        order, steps, before = list(range(k)), [], 0
        for f in order:
            steps.append(self.step(before, f))
            before |= 1 << f
        share, stood, visits = [0] * k, [0] * k, 0
        seen = [(tuple(order), tuple(steps))]
        for i in plain_changes(k):
            visits += 1
            before = sum(1 << f for f in order[:i])
            for f, s in ((order[i], steps[i]), (order[i + 1], steps[i + 1])):
                share[f] += s[1] * (visits - stood[f])
                stood[f] = visits
            order[i], order[i + 1] = order[i + 1], order[i]
            steps[i] = self.step(before, order[i])
            steps[i + 1] = self.step(before | 1 << order[i], order[i + 1])
            seen.append((tuple(order), tuple(steps)))
        for f, s in zip(order, steps):
            share[f] += s[1] * (visits + 1 - stood[f])
        for order_, steps_ in seen:
            name = "".join(self.names[f] for f in order_)
            for at, (f, s) in enumerate(zip(order_, steps_), 1):
                yield (name, at, *s, share[f])


def audit(masked: DataFrame, names: Sequence[str]) -> DataFrame:
    """COUNTS and share of each part, order and step, from rows of part, mask, good and toxic.

    Bit i of a mask stands for names[i] (MOST_FILTERS at most); names are single characters.
    """
    if not 1 <= len(names) <= MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters of one character each")
    names = list(names)
    cells = masked.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic")
    )
    # at most 2^k cells a part
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    columns = ["part", "filter_order", "step", *COUNTS, "shapley"]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, found in zip(frame["part"], frame["cells"]):
                counts = np.zeros((3, 1 << len(names)), np.int64)
                for c in found:
                    counts[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                yield pd.DataFrame([(part, *r) for r in Walk(names, *counts).rows()], columns=columns)

    kinds = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*COUNTS, "shapley"])
    return parts.mapInPandas(walk, kinds)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(masks(docs, labels), "ABCDE")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
