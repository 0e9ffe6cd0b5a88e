"""Near duplicates by DartMinHash.

A text is the multiset of its five-word shingles; an element with weight w owns the region [0, w).
Each unit of a region is hit by darts that a hash of (element, unit) throws: their ranks form a
Poisson process, and each dart has a coordinate. A signature keeps the dart of lowest rank in each
coordinate. Only darts up to a rank that gives K (ln K + 2) of them in expectation are thrown, so
a sketch takes one step per element and dart; a text that leaves a coordinate empty throws on with
a doubled limit. Two signatures agree in a coordinate with the probability of the weighted Jaccard
similarity (sum of minima / sum of maxima).

Texts with equal words are one class at once. Class representatives that agree in all ROWS
coordinates of one of BANDS bands share a bucket (a similarity of 0.8 is missed with probability
(1 - 0.8**5)**25 = 5e-5). Buckets with the same smallest member are one group, so that a text is in
few groups, not in 25 buckets. All similar pairs of a group are found exactly, and the group only
tells a spanning forest of them, at most one link a member:

  * A group of at most MEMBERS texts and ELEMENTS shingles is worked in one task: shared shingles
    of all pairs are counted, by a matrix product for frequent ones, by lists for rare ones.
  * A larger group is split. Its centre C is the set of shingles that more than half of its
    members hold; D is what a member has besides C or lacks of it, |D| its size, and
    a = |D| - |X| / 9. Two members are similar if and only if their D differ in at most a ninth
    of |X| + |Y| elements (0.8 is the threshold). So members with a + a0 <= 0, a0 being the least a,
    are similar to the member of a0 for certain, and any other similar pair shares at least
    (a + a') / 2 > 0 elements of D. A prefix of D, rarest first, that is long enough for this bound
    deals members into smaller groups, one for each element: an element of D is in at most half of
    the members, so each split halves a group at least. Lists with one smallest member are
    one group again, unless this makes it almost as large as it was.

No group is capped and nothing is estimated beyond the buckets. Links become classes by min-label
propagation with shortcuts. Links, labels and shingles stay distributed; shingles are made only of
texts that share a bucket.

Similarity is at least THRESHOLD. Fewer than five words are one shingle; texts without words (null,
empty, signs only) are classes of their own. Of a class the largest doc_id stays; rows that repeat
it are all marked as kept; a null doc_id loses. Texts are told apart by doc_id and a 64-bit hash,
word sequences and shingles by a 64-bit hash. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import cut, fold_words, own_cache, parts_for, with_group

SHINGLE = 5
THRESHOLD = 0.8
K, ROWS, BANDS = 128, 5, 25
DOCS_AT_ONCE = 256
#: What one task works at once: 16 MB of shingles, and a matrix of 36 MB.
MEMBERS, ELEMENTS = 3000, 2_000_000
#: Shingles that more members hold are counted by a matrix product.
FREQUENT = 64

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CACHED_WORDS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, through a cache that is emptied when full."""
    import xxhash

    known = own_cache("op5")
    got = list(map(known.get, words))
    if None in got:
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        got = list(map(known.__getitem__, words))
    return np.array(got, np.uint64)


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a word sequence in order of their hash, and how often each occurs."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = max(1, len(hashes) - size + 1)
    x = np.zeros(n, np.uint64)
    for i in range(min(size, len(hashes))):
        x = _mix(x * _C1 + hashes[i : i + n] + np.uint64(1))
    return np.unique(x, return_counts=True)


def elements(own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset of shingles as a set: the k-th occurrence of a shingle is an element of its own."""
    x, times = own
    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    x = np.repeat(x, times)
    return np.unique(np.where(k > 0, _mix(x + k.astype(np.uint64) * _C1), x))


def sequence_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a word sequence."""
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """Signatures (rows of k 64-bit values) of non-empty weighted sets of 64-bit elements."""
    out = np.zeros((len(sets), k), np.uint64)
    todo, darts = np.arange(len(sets)), k * (math.log(k) + 2)
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([np.asarray(sets[i][1], float) for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        limit = darts / np.bincount(owner, weights=weights, minlength=len(todo))
        units = np.ceil(weights).astype(np.int64)
        unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        cell = _mix(np.repeat(elements, units) * _C1 + unit.astype(np.uint64))
        height = np.minimum(1.0, np.repeat(weights, units) - unit)
        owner = np.repeat(owner, units)
        top = limit[owner]
        rank = np.zeros(len(cell))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(cell):
            step += 1
            h = _mix(cell + np.uint64(step * int(_C3) & (2**64 - 1)))
            rank = rank - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            live = rank < top
            cell, owner, top, rank, height, h = cell[live], owner[live], top[live], rank[live], height[live], h[live]
            dart = _mix(h ^ _C1)
            inside = (_mix(dart) >> np.uint64(11)).astype(float) * 2.0**-53 < height
            found.append((owner[inside] * k + (dart[inside] % np.uint64(k)).astype(np.int64), rank[inside], dart[inside]))
        place = np.concatenate([f[0] for f in found])
        ranks = np.concatenate([f[1] for f in found])
        darts_ = np.concatenate([f[2] for f in found])
        order = np.argsort(-ranks, kind="stable")  # of a place, the lowest rank is written last
        sig, hit = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        sig[place[order]] = darts_[order]
        hit[place] = True
        whole = hit.reshape(-1, k).all(1)
        out[todo[whole]] = sig.reshape(-1, k)[whole]
        todo, darts = todo[~whole], darts * 2
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    keys = []
    for b in range(bands):
        x = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            x = _mix(x * _C1 + signatures[:, b * rows + r])
        keys.append(x)
    return np.stack(keys, 1).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two results of shingles()."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def forest(sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs of sets (arrays of distinct numbers), exactly."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both / max(1, int(size.sum()) - both) >= threshold else []
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    df = np.bincount(token)
    shared = np.zeros((n, n), np.float32)
    rare = (df[token] > 1) & (df[token] <= FREQUENT)
    t, o = token[rare], owner[rare]
    for d in range(1, FREQUENT):
        same = np.flatnonzero(t[:-d] == t[d:])
        if not len(same):
            break
        np.add.at(shared, (o[same], o[same + d]), np.float32(1))
    often = df[token] > FREQUENT
    column = np.cumsum(df > FREQUENT)[token[often]] - 1
    o = owner[often]
    step = max(32, (4 << 20) // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, z = np.searchsorted(column, [at, at + step])
        dense = np.zeros((n, step), np.float32)
        dense[o[a:z], column[a:z] - at] = 1
        shared += dense @ dense.T
    similar = np.zeros((n, n), bool)
    for i in range(n - 1):
        both = shared[i, i + 1 :].astype(float)
        similar[i, i + 1 :] = both / np.maximum(1, size[i] + size[i + 1 :] - both) >= threshold
    similar |= similar.T
    out: list[tuple[int, int]] = []
    new = np.ones(n, bool)
    for root in range(n):
        if not new[root]:
            continue
        new[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(similar[i] & new)
            new[found] = False
            out += [(i, j) for j in found.tolist()]
            queue += found.tolist()
    return out


# --- stages ------------------------------------------------------------------------------------


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), DOCS_AT_ONCE):
            b = whole.slice(at, DOCS_AT_ONCE)
            hashes = [word_hashes(fold_words(t)) for t in b.column(2).to_pylist()]
            some = [i for i, h in enumerate(hashes) if len(h)]
            sig = dart_signatures([shingles(hashes[i]) for i in some]) if some else np.zeros((0, K), np.uint64)
            keys = band_keys(sig) if some else np.zeros((0, BANDS), np.int64)
            cid, bands = [None] * len(b), [None] * len(b)
            for i, k in zip(some, keys):
                cid[i], bands[i] = sequence_id(hashes[i]), k
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(cid, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "cid", "bands"],
            )


def _element_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), DOCS_AT_ONCE):
            b = whole.slice(at, DOCS_AT_ONCE)
            sets = [elements(shingles(word_hashes(fold_words(t)))).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cid", "own"])


def _group_links(threshold: float):
    """Links of groups whose rows (gid, cid, own) follow each other."""

    def links(cids: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        return ((cids[i], cids[j]) for i, j in forest(sets, threshold)) if len(cids) > 1 else iter(())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cids, sets = None, [], []
        for b in batches:
            out: list[tuple[int, int]] = []
            flat, ends = b.column(2).flatten().to_numpy(), b.column(2).value_lengths().to_numpy().cumsum()
            for i, (gid, cid) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if gid != group:
                    out += links(cids, sets)
                    group, cids, sets = gid, [], []
                cids.append(cid)
                sets.append(flat[ends[i - 1] if i else 0 : ends[i]])
            sets = [x.copy() for x in sets]  # the group may go on, but its batch need not stay
            yield _link_batch(out)
        yield _link_batch(list(links(cids, sets)))

    return run


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _split(large: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Certain links (a, b) of large groups (gid, cid), and the smaller groups (gid, cid) that hold all other similar pairs.

    Joins by gid or by a frequent shingle meet one row a key on the other side, so adaptive execution can split them.
    """
    share = (1 - threshold) / (1 + threshold)
    tiny = 1e-9
    whole = cut(large.join(sets, "cid").select("gid", "cid", "own"), "large")
    n = whole.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    df = whole.select("gid", F.explode("own").alias("tok")).groupBy("gid", "tok").agg(F.count(F.lit(1)).alias("df"))
    df = cut(df.filter("df > 1").join(n, "gid").withColumn("lack", F.col("df") * 2 > F.col("n")), "frequent")
    centre = df.filter("lack").groupBy("gid").agg(F.collect_list("tok").alias("centre"))
    none = F.array().cast("array<bigint>")
    own = whole.join(centre, "gid", "left").withColumn("centre", F.coalesce("centre", none)).select(
        "gid", "cid", F.size("own").alias("size"), F.array_except("own", "centre").alias("extra"), F.array_except("centre", "own").alias("lacks")
    )
    own = own.withColumn("far", F.size("extra") + F.size("lacks"))
    own = cut(own.withColumn("a", F.col("far") - F.lit(share) * F.col("size")), "differences")
    nearest = own.groupBy("gid").agg(F.min(F.struct("a", "cid")).alias("top")).select("gid", F.col("top.a").alias("a0"), F.col("top.cid").alias("c0"))
    own = own.join(nearest, "gid").withColumn("sure", F.col("a") + F.col("a0") <= tiny)
    certain = own.filter("sure and cid <> c0").select(F.col("c0").alias("a"), F.col("cid").alias("b"))
    # partners of a sure member that matter are not sure, so their a is above -a0; partners of the others have an a of a0 or more
    need = F.greatest(F.lit(1), F.ceil(F.when(F.col("sure"), F.col("a") - F.col("a0")).otherwise(F.col("a") + F.col("a0")) / 2 - tiny))
    tagged = F.concat(
        F.transform("extra", lambda x: F.struct(x.alias("tok"), F.lit(False).alias("lack"))),
        F.transform("lacks", lambda x: F.struct(x.alias("tok"), F.lit(True).alias("lack"))),
    )
    rows = own.select("gid", "cid", "sure", "far", (F.col("far") - need + 1).alias("reach"), F.inline(tagged))
    often = df.select("gid", "tok", "lack", F.when(F.col("lack"), F.col("n") - F.col("df")).otherwise(F.col("df")).alias("times")).filter("times > 1")
    met = rows.join(often, ["gid", "tok", "lack"]).groupBy("gid", "cid", "sure", "far", "reach").agg(
        F.sort_array(F.collect_list(F.struct("times", "tok", "lack"))).alias("d")
    )
    take = F.col("reach") - F.col("far") + F.size("d")  # what only this member has comes first and meets nobody
    prefix = met.filter(take > 0).select("gid", "cid", "sure", F.inline(F.slice("d", F.lit(1), F.least(take, F.size("d")).cast("int"))))
    prefix = cut(prefix.select("gid", "cid", "sure", "tok", "lack"), "prefixes")
    lists = prefix.groupBy("gid", "tok", "lack").agg(F.min("cid").alias("lead"), F.count(F.lit(1)).alias("many"), F.min("sure").alias("closed"))
    lists = lists.filter("many > 1 and not closed").drop("many", "closed")
    met = cut(prefix.drop("sure").join(lists, ["gid", "tok", "lack"]), "lists")
    merged = met.select("gid", "lead", "cid").distinct()
    size = merged.groupBy("gid", "lead").agg(F.count(F.lit(1)).alias("many")).join(n, "gid")
    small, wide = size.filter("many * 4 <= n * 3").select("gid", "lead"), size.filter("many * 4 > n * 3").select("gid", "lead")
    by_lead = merged.join(small, ["gid", "lead"]).select(F.xxhash64("gid", "lead").alias("gid"), "cid")
    by_list = met.join(wide, ["gid", "lead"]).select(F.xxhash64("gid", "tok", "lack").alias("gid"), "cid")
    return cut(certain, "certain"), cut(by_lead.unionByName(by_list), "groups")


def links_of(groups: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, members: int | None = None, most: int | None = None) -> DataFrame:
    """Links (a, b) that join what the similar pairs of groups (gid, cid) join."""
    members, most = members or MEMBERS, most or ELEMENTS
    sized = sets.select("cid", "own", F.size("own").alias("size"))
    found: list[DataFrame] = []
    while True:
        sizes = groups.join(sized.select("cid", "size"), "cid").groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        sizes = cut(sizes.filter("n > 1").select("gid", ((F.col("n") > members) | (F.col("size") > most)).alias("large")), "sizes")
        groups = groups.join(sizes, "gid")
        rows = groups.filter("not large").join(sized, "cid").select("gid", "cid", "own")
        rows = rows.repartition("gid").sortWithinPartitions("gid")
        found.append(cut(rows.mapInArrow(_group_links(threshold), "a long, b long"), "links"))
        if sizes.filter("large").isEmpty():
            break
        certain, groups = _split(groups.filter("large").select("gid", "cid"), sets, threshold)
        found.append(certain)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


LINKS_A_PART = 250_000


def components(links: DataFrame) -> DataFrame:
    """v, label: the smallest node that each linked node reaches.

    The tables of an iteration are written in parts of about LINKS_A_PART links.
    """
    links = cut(links.select("a", "b"), "links")
    parts = parts_for(links.count(), LINKS_A_PART)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = cut(both.coalesce(parts), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")).coalesce(parts), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("v").alias("new"), F.col("new").alias("far"))
        moved = step.join(jump, "new", "left").select("v", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("old"))
        after = cut(moved.coalesce(parts), "labels")
        labels = after.select("v", "label")
        if after.filter("label <> old").isEmpty():
            return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id, class_size, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    sketches = cut(rows.mapInArrow(_sketch, "doc_id long, text_hash long, cid long, bands array<bigint>"), "sketches")
    reps = (
        sketches.filter("cid is not null")
        .groupBy("cid")
        .agg(F.max(F.struct("doc_id", "text_hash")).alias("top"), F.first("bands").alias("bands"))
    )
    reps = cut(reps, "reps")
    members = reps.select("cid", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("gid")).filter("n > 1")
    groups = cut(members.join(buckets.select("key", "gid"), "key").select("gid", "cid").distinct(), "groups")
    texts = groups.select("cid").distinct().join(reps.select("cid", "top.doc_id", "top.text_hash"), "cid")
    # texts move once; of rows that repeat an id and a text one is taken afterwards
    found = texts.alias("t").join(
        rows.alias("r"),
        F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("t.text_hash").eqNullSafe(F.col("r.text_hash")),
    )
    sets = cut(found.select("t.cid", "r.text").dropDuplicates(["cid"]).mapInArrow(_element_rows, "cid long, own array<bigint>"), "shingles")
    labels = components(links_of(groups, sets, threshold))

    # a class that several word sequences share has the label of all; others are classes of their own
    named = sketches.select("doc_id", "text_hash", "cid").withColumn("row", F.when(F.col("cid").isNull(), F.monotonically_increasing_id()))
    salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(16)).cast("int")
    named = named.withColumn("salt", salt)
    lut = named.select("cid", "salt").distinct().join(labels.withColumnRenamed("v", "cid"), "cid")
    named = named.join(lut, ["cid", "salt"], "left").withColumn("label", F.coalesce("label", "cid")).select("doc_id", "text_hash", "label", "row")
    out = with_group(named, ["label", "row"], "doc_id", "class_id", "class_size")
    return out.select("doc_id", "text_hash", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


# All pairs of texts that share a shingle, by their weighted Jaccard similarity, then classes by the least member that is reached.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT w, min(n) AS id FROM d WHERE len(w) > 0 GROUP BY w),
s AS (
  SELECT id, sh, count(*) AS c
  FROM (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS sh FROM t)
  GROUP BY id, sh
), z AS (SELECT id, sum(c) AS size FROM s GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, sum(least(a.c, b.c)) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY a.id, b.id),
e AS (
  SELECT x, y FROM p JOIN z zx ON zx.id = x JOIN z zy ON zy.id = y
  WHERE common::DOUBLE / greatest(1, zx.size + zy.size - common) >= {threshold}::DOUBLE
), g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(a, b) AS (SELECT id, id FROM t UNION SELECT r.a, g.y FROM r JOIN g ON g.x = r.b),
l AS (SELECT a AS id, min(b) AS label FROM r GROUP BY a),
m AS (SELECT d.n, doc_id, coalesce(label, -d.n) AS label FROM d LEFT JOIN t ON d.w = t.w LEFT JOIN l ON l.id = t.id),
c AS (SELECT label, max(doc_id) AS class_id, count(*) AS class_size FROM m GROUP BY label)
SELECT doc_id, class_id, class_size, doc_id IS NOT DISTINCT FROM class_id AS kept FROM m JOIN c USING (label)
""".replace("{threshold}", str(THRESHOLD))
