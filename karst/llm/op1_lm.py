"""Language-model scoring by a weighted backoff automaton.

States are the histories that were seen in training, arcs the n-grams; a history without an arc
for the next word takes its failure arc to the history without its first word, at a cost. One
walk from left to right carries the state through a text and adds up log-probabilities.

Weights are those of hierarchical Dirichlet smoothing: with c the training counts,

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + m * p(w | h')) / (c(h) + m)      h' = h without its first word

so an arc weighs log10 p(w | h) and a failure arc log10 m / (c(h) + m).

The whole model never stands in one place. Texts are dealt into batches of about BATCH_BYTES. A
batch names its n-grams by 64-bit hashes, in order, and sends each range of hashes (a bucket) with
the batch's training counts. A bucket adds up the counts of all batches and answers each with the
totals of what it named, in the same order, and with the bucket's share of N and V. From the
answers a batch builds the part of the automaton that its texts can reach, and walks it. Which
batch a row is in is written down, with its text, before either; answers of another length than the
batch's list are an error. Batches
and buckets grow in number with the input, not in size; a frequent n-gram is one entry a batch.
Messages don't grow with batches times buckets: where there are more buckets than FAN, hashes are
sent in several hops, each to at most FAN ranges, and between hops the messages of FAN batches to
one range are put together; the answers come back the same way.

N-grams are told apart by 62 bits of a hash; two of 10**6 distinct ones fall together with
probability 1e-7, two of 10**9 in about one of ten corpora, and then share their count.

Null texts count as empty; an empty text is the end token alone. Rows are independent: repeated
rows count repeatedly in training and give repeated results. An empty table gives no rows; without
training rows every probability is 1. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import cut, id_mod, parts_for, text_bytes

ORDER = 2
STRENGTH = 300.0
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
FAN = 256
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: The lowest two bits of a key: a token, or anything else.
_TOKEN, _GRAM = np.uint64(1), np.uint64(2)
_KIND = np.uint64(3)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _A) ^ b
    x = (x ^ (x >> np.uint64(30))) * _B
    return x ^ (x >> np.uint64(27))


def planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second, and so on: of sorted or small numbers most bytes then repeat."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype)[:, 0]


class Grams:
    """The n-grams of a batch of texts: for each place of the sequence <start> words <end>."""

    def __init__(self, texts: pa.Array, order: int):
        import xxhash

        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        n = len(words)
        k = coded.indices.to_numpy().astype(np.int64)
        if "" in words:  # the splitter gives one for white space at an edge, and for an empty text
            real = k != words.index("")
            offsets, k = np.concatenate([[0], np.cumsum(real)])[offsets], k[real]
        k = np.insert(k, offsets[1:], n)  # ends
        first = offsets[:-1] + np.arange(len(texts))
        self.words = np.insert(k, first, n + 1)  # starts
        self.n_words = n + 2
        self.starts = offsets + 2 * np.arange(len(texts) + 1)
        named = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
        h = np.concatenate([named, [_END, _START]]).astype(np.uint64)[self.words]
        place = np.arange(len(self.words)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        self.place = place
        is_start = place == 0
        keys = [(_mix(h, np.uint64(1)) & ~_KIND) | np.where(is_start, _GRAM, _TOKEN)]
        gram = h
        for size in range(2, order + 1):
            gram = np.concatenate([[np.uint64(0)], _mix(gram[:-1], h[1:])])
            keys.append((_mix(gram, np.uint64(size)) & ~_KIND) | _GRAM)
        valid = [np.ones(len(h), bool), *[place >= size - 1 for size in range(2, order + 1)]]
        flat = np.concatenate([x[v] for x, v in zip(keys, valid)])
        self.keys, example, inverse = np.unique(flat, return_index=True, return_inverse=True)
        where = np.concatenate([np.flatnonzero(v) for v in valid])
        size_of = np.concatenate([np.full(v.sum(), i + 1) for i, v in enumerate(valid)])
        self.example, self.size = where[example], size_of[example]
        #: number of the n-gram of each size that ends at each place, -1 where it would reach before the start
        self.at = []
        done = 0
        for v in valid:
            own = np.full(len(h), -1, np.int64)
            own[v] = inverse[done : done + v.sum()]
            done += v.sum()
            self.at.append(own)

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each key occurs in the training texts of the batch."""
        use = np.repeat(train.astype(np.int64), np.diff(self.starts))
        total = np.zeros(len(self.keys), np.int64)
        for own in self.at:
            ok = own >= 0
            total += np.bincount(own[ok], weights=use[ok], minlength=len(self.keys)).astype(np.int64)
        return total


def limits(first: int, ranges: int, whole: int) -> np.ndarray:
    """The least hash of ranges first + 1 to first + ranges - 1, of a hash space in `whole` equal ranges."""
    return np.array([((first + i) << 64) // whole for i in range(1, ranges)], np.uint64)


def cuts(keys: np.ndarray, first: int, ranges: int, whole: int) -> np.ndarray:
    """Where the sorted keys of each of the ranges begin, and the end."""
    return np.concatenate([[0], np.searchsorted(keys, limits(first, ranges, whole)), [len(keys)]]).astype(np.int64)


def matched(grams: Grams, answers: list[np.ndarray]) -> np.ndarray:
    """The totals of the keys of a batch, from the answers in the order of their ranges."""
    totals = np.concatenate([*answers, np.zeros(0, np.int64)])
    if len(totals) != len(grams.keys):
        raise ValueError(f"{len(totals)} answers to {len(grams.keys)} n-grams: the batch has changed since it asked")
    return totals


class Automaton:
    """States, arcs and failure arcs that a batch's texts can reach."""

    def __init__(self, grams: Grams, totals: np.ndarray, n: int, v: int, strength: float = STRENGTH):
        g, order = grams, len(grams.at)
        n_keys = len(g.keys)
        self.root = n_keys
        self.width = g.n_words
        p = np.ones(n_keys)
        source = np.full(n_keys, self.root)
        suffix = np.full(n_keys, self.root)
        one = g.size == 1
        p[one] = (totals[one] + 1) / (n + v + 1)
        for size in range(2, order + 1):
            own = np.flatnonzero(g.size == size)
            at = g.example[own]
            source[own] = g.at[size - 2][at - 1]
            suffix[own] = g.at[size - 2][at]
            p[own] = (totals[own] + strength * p[suffix[own]]) / (totals[source[own]] + strength)
        seen = totals > 0
        log_p = np.log10(p)
        self.log_token = log_p
        # after the longest n-gram the state is its suffix; after a shorter one it is the n-gram itself
        dest = np.where(g.size == order, suffix, np.arange(n_keys)) if order > 1 else np.full(n_keys, self.root)
        dest = np.where(seen, dest, self.root)
        arcs = np.flatnonzero((one & (g.at[0][g.example] >= 0)) | seen)
        word = g.words[g.example[arcs]]
        self.arc = dict(zip((source[arcs] * self.width + word).tolist(), arcs.tolist()))
        self.weight, self.dest = log_p.tolist(), dest.tolist()
        self.fail = suffix.tolist()
        self.fail_weight = np.log10(strength / (totals + strength)).tolist()

    def walk(self, start: int, words: list[int]) -> float:
        """The log-probability of words from a state."""
        arc, weight, dest, fail, cost, width = self.arc.get, self.weight, self.dest, self.fail, self.fail_weight, self.width
        state, total = start, 0.0
        for w in words:
            a = arc(state * width + w)
            while a is None:
                total += cost[state]
                state = fail[state]
                a = arc(state * width + w)
            total += weight[a]
            state = dest[a]
        return total


def _text_rows(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
    table = table.combine_chunks()
    col = lambda name: table.column(name).combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)
    return col("text"), col("train").to_numpy(zero_copy_only=False).astype(bool), col("doc_id")


def run(docs: DataFrame, modulus: int = 7, held_out: int = 2, order: int = ORDER, strength: float = STRENGTH,
        batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = text_bytes(rows)
    batches, buckets = parts_for(size, batch_bytes), parts_for(size, bucket_bytes)
    hops = 1
    while fan**hops < buckets:
        hops += 1
    split = next(f for f in range(1, fan + 1) if f**hops >= buckets)  # ranges of a hop
    # the input partition is part of the hash, so that rows which repeat don't all meet in one batch; what it
    # gives is written, as both uses of the rows must find each row in the same batch
    dealt = rows.select(
        F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(batches)).cast("long").alias("node"),
        "doc_id",
        "text",
        (id_mod("doc_id", modulus) != held_out).alias("train"),
    )
    rows = cut(dealt, "dealt")

    def ask(table: pa.Table) -> pa.Table:
        texts, train, _ = _text_rows(table)
        grams = Grams(texts, order)
        keys, counts = grams.keys.astype("<u8"), grams.counts(train).astype("<u8")
        at = cuts(keys, 0, split, split)
        pick = lambda x: [x[at[i] : at[i + 1]] for i in range(split)]
        return _messages(range(split), [table.column("node")[0].as_py()] * split, pick(keys), pick(counts))

    def onward(whole: int):
        """Put the messages of nodes to one of `whole` / split ranges together, and send them to its parts."""

        def run(table: pa.Table) -> pa.Table:
            first = table.column("range")[0].as_py() * split
            _, keys, counts = _read(table)
            at = [cuts(k, first, split, whole) for k in keys]
            own, times = ([np.concatenate([y[a[i] : a[i + 1]] for y, a in zip(x, at)]) for i in range(split)] for x in (keys, counts))
            order = [np.argsort(x, kind="stable") for x in own]
            node = table.column("node")[0].as_py() // fan
            pick = lambda x: [y[o] for y, o in zip(x, order)]
            return _messages(range(first, first + split), [node] * split, pick(own), pick(times))

        return run

    def answer(table: pa.Table) -> pa.Table:
        nodes, keys, counts = _read(table)
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
        token = (u & _KIND) == _TOKEN
        n, v = int(total[token].sum()), int((total[token] > 0).sum())
        ends = np.cumsum([len(k) for k in keys])
        told = [total[inverse[e - len(k) : e]] for k, e in zip(keys, ends)]
        return _answers([table.column("range")[0].as_py()] * len(nodes), nodes, told, n, v)

    def back(whole: int):
        """Deal the answers of a range's parts to the nodes whose messages were put together."""

        def run(table: pa.Table, told: pa.Table) -> pa.Table:
            one = table.column("range")[0].as_py()
            nodes, keys, _ = _read(table)
            at = [cuts(k, one * split, split, whole) for k in keys]
            parts: list[list[np.ndarray]] = [[] for _ in nodes]
            told = told.sort_by("range")
            for i, sorted_ in enumerate(_totals(told)):
                order = np.argsort(np.concatenate([k[a[i] : a[i + 1]] for k, a in zip(keys, at)]), kind="stable")
                total, done = np.zeros_like(sorted_), 0
                total[order] = sorted_
                for own, a in zip(parts, at):
                    own.append(total[done : done + a[i + 1] - a[i]])
                    done += a[i + 1] - a[i]
            n, v = pc.sum(told.column("n")).as_py(), pc.sum(told.column("v")).as_py()
            return _answers([one] * len(nodes), nodes, [np.concatenate(x) for x in parts], n, v)

        return run

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        texts, train, ids = _text_rows(table)
        if not len(texts):
            return _RESULT.empty_table()
        grams = Grams(texts, order)
        told = told.sort_by("range")
        totals = matched(grams, _totals(told))
        n, v = pc.sum(told.column("n")).as_py(), pc.sum(told.column("v")).as_py()
        automaton = Automaton(grams, totals, n, v, strength)
        begin, known, base, scores = grams.starts, [], [], []
        first = grams.at[0]
        for i in range(len(texts)):
            own = slice(begin[i] + 1, begin[i + 1])
            tokens = first[own]
            known.append(int((totals[tokens] > 0).sum()))
            base.append(round(float(automaton.log_token[tokens].sum()), 6))
            start = int(first[begin[i]])
            state = start if order > 1 and totals[start] > 0 else automaton.root
            scores.append(round(automaton.walk(state, grams.words[own].tolist()), 6))
        return pa.Table.from_arrays(
            [
                ids,
                pa.array(~train),
                pa.array(np.diff(begin) - 1, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array([n] * len(texts), pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(scores, pa.float64()),
            ],
            schema=_RESULT,
        )

    sent = [rows.groupBy("node").applyInArrow(ask, _MESSAGE)]
    put = F.floor(F.col("node") / fan).alias("put")
    for hop in range(1, hops):
        sent.append(sent[-1].groupBy("range", put).applyInArrow(onward(split ** (hop + 1)), _MESSAGE))
    told = sent[-1].groupBy("range").applyInArrow(answer, _ANSWER)
    for hop in range(hops - 1, 0, -1):
        asked = sent[hop - 1].groupBy(F.col("range").alias("of"), put)
        of = F.floor(F.col("range") / split).alias("of")
        told = asked.cogroup(told.groupBy(of, F.col("node").alias("put"))).applyInArrow(back(split ** (hop + 1)), _ANSWER)
    return (
        rows.groupBy("node")
        .cogroup(told.groupBy("node"))
        .applyInArrow(
            score,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


_MESSAGE = "range long, node long, keys binary, width int, counts binary"
_ANSWER = "range long, node long, width int, totals binary, n long, v long"


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8" if len(x) and x.max() >= 1 << 32 else "<u4")


def _messages(ranges, nodes: list[int], keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.Table:
    """Messages with their keys and counts, as they are; ranges without a key too."""
    small = [_narrow(x) for x in counts]
    return pa.table(
        {
            "range": pa.array(ranges, pa.int64()),
            "node": pa.array(nodes, pa.int64()),
            "keys": pa.array([planes(x) for x in keys], pa.binary()),
            "width": pa.array([x.itemsize for x in small], pa.int32()),
            "counts": pa.array([planes(x) for x in small], pa.binary()),
        }
    )


def _read(table: pa.Table) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Nodes in their order, and the keys and counts that each sent."""
    table = table.sort_by("node")
    keys = [from_planes(x.as_buffer(), "<u8") for x in table.column("keys")]
    widths = table.column("width").to_pylist()
    counts = [from_planes(x.as_buffer(), f"<u{w}") for x, w in zip(table.column("counts"), widths)]
    return table.column("node").to_pylist(), keys, counts


def _answers(ranges: list[int], nodes: list[int], totals: list[np.ndarray], n: int, v: int) -> pa.Table:
    small = [_narrow(x) for x in totals]
    return pa.table(
        {
            "range": pa.array(ranges, pa.int64()),
            "node": pa.array(nodes, pa.int64()),
            "width": pa.array([x.itemsize for x in small], pa.int32()),
            "totals": pa.array([planes(x) for x in small], pa.binary()),
            "n": pa.array([n] * len(small), pa.int64()),
            "v": pa.array([v] * len(small), pa.int64()),
        }
    )


def _totals(told: pa.Table) -> list[np.ndarray]:
    widths = told.column("width").to_pylist()
    return [from_planes(x.as_buffer(), f"<u{w}").astype(np.int64) for x, w in zip(told.column("totals"), widths)]


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 bit by bit, for DuckDB has no such function.
CRC32_SQL = """xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT),
  lambda c, b: list_reduce(range(8)::BIGINT[], lambda z, k: xor(z >> 1, 3988292384 * (z & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), m AS (SELECT doc_id, w, {CRC32_SQL} % 7 = 2 AS held_out FROM d),
t AS (
  SELECT doc_id, held_out, CASE WHEN i > len(w) THEN ' end' ELSE w[i] END AS tok, CASE WHEN i = 1 THEN ' start' ELSE w[i - 1] END AS prev
  FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM m)
), u AS (SELECT tok, count(*) AS c FROM t WHERE NOT held_out GROUP BY tok),
b AS (SELECT prev, tok, count(*) AS c FROM t WHERE NOT held_out GROUP BY prev, tok),
h AS (SELECT prev, count(*) AS c FROM t WHERE NOT held_out GROUP BY prev),
nv AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM u),
x AS (
  SELECT t.doc_id, t.held_out, u.c AS uc, coalesce(b.c, 0) AS bc, coalesce(h.c, 0) AS hc, n, (coalesce(u.c, 0) + 1)::DOUBLE / (n + v + 1) AS p
  FROM t CROSS JOIN nv LEFT JOIN u ON t.tok = u.tok LEFT JOIN b ON t.tok = b.tok AND t.prev = b.prev LEFT JOIN h ON t.prev = h.prev
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(uc) AS n_known, any_value(n) AS train_tokens, round(sum(log10(p)), 6) AS base_score,
  round(sum(log10((bc + {STRENGTH}::DOUBLE * p) / (hc + {STRENGTH}::DOUBLE))), 6) AS score
FROM x GROUP BY doc_id, held_out
"""
