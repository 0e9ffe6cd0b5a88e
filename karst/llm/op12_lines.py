"""Quality rules, and a linear-chain conditional random field over a text's lines.

The rules count words, symbols, lines that repeat and words in windows that repeat. Then each line
with a word is a place of a chain; its features are shares of kinds of characters, the sizes of its
words, and whether it repeats, cut into bins. Viterbi decoding marks each line as content or
boilerplate, and a text stays if at least KEEP_SHARE of its words stand in content.

The field is fitted on labelled documents, whose label speaks of the whole: the lines of good ones
are content; those of bad ones begin as boilerplate, and each of ROUNDS fits decodes them anew with
the model of the fit before, so that a clean line in a bad document doesn't count as boilerplate.
The first fit leaves neighbours out, as the labels that it begins with never change within a text.
The sample is bounded: about SAMPLE_ROWS label rows, half of them good, chosen by the hash of the
id among those whose crc32(doc_id) mod `modulus` isn't 0, and about SAMPLE_CHAINS chains of CHAIN
lines from them. The fit sees bins only, never words, so it holds for any language.

Null texts have no words. Texts without words fail the rules. Without labels of both kinds nothing
is called boilerplate. Rows are independent: repeated rows give repeated results, an empty table
none. Extra columns are ignored. Whole texts are read, one at a time; long ones take memory in
proportion to their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import cut, id_mod

SAMPLE_ROWS = 2400
SAMPLE_CHAINS = 6000
CHAIN = 64
ROUNDS, STEPS, RATE, DECAY = 3, 60, 0.1, 1e-3
KEEP_SHARE = 0.5
WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = b"#*$%&|<>"

#: Kinds of bytes: space, small and capital letters, digits, symbols, bars, ends of sentences, commas, other signs, first and later bytes of other characters.
SPACE, SMALL, CAPITAL, DIGIT, SYMBOL, BAR, STOP, COMMA, SIGN, LEAD, LATER = range(11)


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return LATER if b < 0xC0 else LEAD
    if b == 0x20 or 0x09 <= b <= 0x0D:
        return SPACE
    if c.isalpha():
        return SMALL if c.islower() else CAPITAL
    if c.isdigit():
        return DIGIT
    return BAR if c == "|" else SYMBOL if b in SYMBOLS else STOP if c in ".!?" else COMMA if c in ",;:" else SIGN


_KINDS = np.array([_kind(b) for b in range(256)], np.uint8)
#: Bounds of the bins of shares.
_SHARE = np.array([0.0, 0.01, 0.03, 0.1, 0.25, 0.5])
_PER_WORD = np.array([0.0, 0.02, 0.06, 0.15, 0.35, 0.7])
_LENGTH = np.array([2.0, 3.0, 4.0, 5.0, 6.5, 9.0, 15.0])
_COUNT = np.array([1, 3, 7, 15, 31, 63, 255])
BINS, FEATURES = 8, 13


@dataclass
class Lines:
    """Counts of a text; of its lines with a word, their number among all lines, words and bins."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    at: np.ndarray
    words: np.ndarray
    bins: np.ndarray  # lines x FEATURES

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeated(rank: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Marks the words in windows of `size` (a power of two) words, given by number, that occur twice or more.

    Windows get exact numbers by doubling: a window's number is that of the pair of its halves.
    """
    n = len(rank)
    marks = np.zeros(n, bool)
    if n <= size:
        return marks
    width = 1
    while width < size:
        pairs = rank[:-width] * (n + 1) + rank[width:]
        _, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return marks  # all windows of this width differ
        width *= 2
    twice = np.flatnonzero(counts[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + size, -1)
    return np.cumsum(edge[:-1]) > 0


def read(raw: bytes) -> Lines:
    """The counts and lines of a text in UTF-8."""
    line_texts = raw.split(b"\n")
    data = np.frombuffer(raw + b"\n", np.uint8)
    kinds = _KINDS[data]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    space = kinds == SPACE
    first = ~space
    first[1:] &= space[:-1]
    words = np.add.reduceat(first, starts, dtype=np.int64)
    some = np.flatnonzero(words)
    kind = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64)[some] for k in range(11)])
    n_words = int(words.sum())
    rank = numbered(raw.split())
    marks = repeated(rank)
    seen: set[bytes] = set()
    dup = np.zeros(len(some), bool)
    for i, at in enumerate(some.tolist()):
        line = line_texts[at]
        dup[i] = line in seen
        seen.add(line)
    w = words[some]
    until = np.cumsum(w)

    def share(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return (upto[until] - upto[until - w]) / w

    again, stutter = share(marks), share(np.diff(rank, prepend=-1) == 0)
    chars = np.maximum(kind[1:LATER].sum(0), 1)
    letters = np.maximum(kind[SMALL] + kind[CAPITAL] + kind[LEAD], 1)
    last = _KINDS[[line_texts[at].rstrip()[-1] for at in some.tolist()]] if len(some) else np.zeros(0, np.uint8)
    bins = np.zeros((len(some), FEATURES), np.uint8)
    for i, (value, bounds) in enumerate(
        (
            (w, _COUNT),
            (kind[CAPITAL] / letters, _SHARE),
            (kind[DIGIT] / chars, _SHARE),
            (kind[SYMBOL] / chars, _SHARE),
            (kind[BAR] / w, _PER_WORD),
            (kind[SIGN] / chars, _SHARE),
            (kind[STOP] / w, _PER_WORD),
            (kind[COMMA] / w, _PER_WORD),
            (chars / w, _LENGTH),
            (again, _SHARE),
            (stutter, _SHARE),
            (dup, np.array([0.5])),
            (last == STOP, np.array([0.5])),
        )
    ):
        bins[:, i] = np.searchsorted(bounds, value)
    return Lines(
        n_words,
        len(kinds) - int(space.sum()) - int((kinds == LATER).sum()),
        int(kind[SYMBOL].sum() + kind[BAR].sum()),
        int(dup.sum()),
        int(marks.sum()),
        some,
        w,
        bins,
    )


@dataclass
class Field:
    """Weights of the bins for boilerplate against content, of the first label, and of neighbours (0 content, 1 boilerplate)."""

    weights: np.ndarray  # FEATURES * BINS
    start: float
    pairs: np.ndarray  # 2 x 2

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins + np.arange(FEATURES) * BINS].sum(1) if len(bins) else np.zeros(0)

    def decode(self, bins: np.ndarray) -> np.ndarray:
        """The likeliest labels of a chain; content where both are as likely."""
        unary = self.scores(bins).tolist()
        n = len(unary)
        if not n:
            return np.zeros(0, np.uint8)
        (cc, cb), (bc, bb) = self.pairs.tolist()
        c, b = 0.0, unary[0] + self.start
        back = bytearray(n)  # bit 0: where content comes from, bit 1: where boilerplate comes from
        for t in range(1, n):
            back[t] = (b + bc > c + cc) | (b + bb > c + cb) << 1
            c, b = max(c + cc, b + bc), max(c + cb, b + bb) + unary[t]
        out = np.zeros(n, np.uint8)
        label = int(b > c)
        for t in range(n - 1, -1, -1):
            out[t] = label
            label = back[t] >> label & 1
        return out


def blank_field() -> Field:
    """Calls nothing boilerplate."""
    return Field(np.zeros(FEATURES * BINS), 0.0, np.zeros((2, 2)))


def likelihood(field: Field, bins: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Log-likelihood of the labels of chains, and its gradient by weights, start and pairs.

    bins: those of all lines, chain by chain; lengths: of the chains, falling; labels: chains x places.
    """
    n, places = len(lengths), lengths[0]
    inside = np.arange(places) < lengths[:, None]
    unary = np.zeros((n, places))
    unary[inside] = field.scores(bins)
    live = [int((lengths > t).sum()) for t in range(places)]
    ahead = np.zeros((n, places, 2))
    behind = np.zeros((n, places, 2))
    ahead[:, 0, 1] = unary[:, 0] + field.start
    for t in range(1, places):
        k = live[t]
        from_ = ahead[:k, t - 1, :, None] + field.pairs
        ahead[:k, t] = np.logaddexp(from_[:, 0], from_[:, 1])
        ahead[:k, t, 1] += unary[:k, t]
    for t in range(places - 2, -1, -1):
        k = live[t + 1]
        after = behind[:k, t + 1].copy()
        after[:, 1] += unary[:k, t + 1]
        to = field.pairs + after[:, None, :]
        behind[:k, t] = np.logaddexp(to[:, :, 0], to[:, :, 1])
    last = ahead[np.arange(n), lengths - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    p = np.exp(np.minimum(ahead[:, :, 1] + behind[:, :, 1] - total[:, None], 0)) * inside
    y = labels * inside
    value = float((y * unary).sum() + (y[:, 0] * field.start).sum() - total.sum())
    by_pair = np.zeros((2, 2))
    for t in range(1, places):
        k = live[t]
        if not k:
            break
        joint = ahead[:k, t - 1, :, None] + field.pairs + behind[:k, t, None, :]
        joint[:, :, 1] += unary[:k, t, None]
        by_pair -= np.exp(joint - total[:k, None, None]).sum(0)
        pair = np.bincount(2 * labels[:k, t - 1] + labels[:k, t], minlength=4).reshape(2, 2)
        by_pair += pair
        value += float((pair * field.pairs).sum())
    left = np.repeat((y - p)[inside], FEATURES)
    by_weight = np.bincount((bins + np.arange(FEATURES) * BINS).ravel(), left, minlength=FEATURES * BINS)
    return value, by_weight, float((y - p)[:, 0].sum()), by_pair


def fit_chains(chains: list[np.ndarray], good: np.ndarray) -> Field:
    """Fit on chains of bins and whether each is of a good document."""
    if not len(chains) or good.all() or not good.any():
        return blank_field()
    order = np.argsort([-len(c) for c in chains], kind="stable")
    lengths = np.array([len(chains[i]) for i in order])
    good = good[order]
    bins = np.concatenate([chains[i] for i in order])
    labels = np.repeat((~good).astype(np.int64)[:, None], lengths[0], axis=1)
    n_lines = lengths.sum()
    field = blank_field()
    for round_ in range(ROUNDS):
        field = blank_field()
        moment, square = np.zeros(FEATURES * BINS + 5), np.zeros(FEATURES * BINS + 5)
        for step in range(1, STEPS + 1):
            _, w, s, p = likelihood(field, bins, lengths, labels)
            now = np.concatenate([field.weights, [field.start], field.pairs.ravel()])
            slope = np.concatenate([w, [s], p.ravel()]) / n_lines - DECAY * now
            if not round_:
                slope[-5:] = 0
            moment = 0.9 * moment + 0.1 * slope
            square = 0.99 * square + 0.01 * slope**2
            now += RATE * moment / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            field = Field(now[:-5], float(now[-5]), now[-4:].reshape(2, 2))
        for row in np.flatnonzero(~good):
            k = lengths[row]
            found = field.decode(chains[order[row]])
            labels[row, :k] = found if found.any() else 1
    return field


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample_rows: int = SAMPLE_ROWS, sample_chains: int = SAMPLE_CHAINS) -> Field:
    """Learn from documents with a label `quality` of 0 or 1, leaving out those whose crc32(doc_id) mod `modulus` is 0."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_mod("doc_id", modulus) != 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("good"))
    sizes = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if len(sizes) < 2:
        return blank_field()
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("good") == value, F.lit(min(1.0, sample_rows / 2 / n))).otherwise(share)
    million = F.lit(1_000_003)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), million) < share * million).select(F.col("doc_id").alias("id"), "good")

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, good, text in zip(*(c.to_pylist() for c in b.columns)):
                found = read(text or b"")
                groups = np.split(found.bins, np.flatnonzero(np.diff(found.at // CHAIN)) + 1)
                rows = [(doc_id, good, i, g.tobytes()) for i, g in enumerate(groups) if len(g)]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    cols = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "good", "chain", "bins"])

    # the sample of labels has a bound, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", F.col("good").cast("int").alias("good"), "text")
    table = cut(rows.mapInArrow(chains, "doc_id long, good int, chain int, bins binary"), "chains")
    n = table.count()
    part = F.pmod(F.xxhash64("doc_id", "chain"), million) < F.lit(min(1.0, sample_chains / max(n, 1))) * million
    got = sorted(table.filter(part).distinct().collect())
    return fit_chains([np.frombuffer(r["bins"], np.uint8).reshape(-1, FEATURES) for r in got], np.array([r["good"] == 1 for r in got], bool))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_words long, n_boilerplate_lines long, kept boolean"
)


def judge(docs: DataFrame, field: Field, keep_share: float = KEEP_SHARE) -> DataFrame:
    """SCHEMA of every document: one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.start, field.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*shared.value)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0), b.column(1)):
                found = read(text.as_py() or b"")
                marks = model.decode(found.bins)
                content = int(found.words[marks == 0].sum())
                failed = found.base_failed
                kept = not failed and content >= keep_share * found.n_words
                counts = found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words
                rows.append((doc_id.as_py(), *counts, failed, content, int(marks.sum()), kept))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)

    whole, flag = pa.int64(), pa.bool_()
    arrow = pa.schema([(c.split()[0], whole if c.endswith("long") else flag) for c in SCHEMA.split(", ")])
    names = arrow.names
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def marked_lines(text: str | None, field: Field) -> list[tuple[str, bool]]:
    """The lines of a text that hold a word, and whether each is content."""
    raw = (text or "").encode()
    found = read(raw)
    lines = raw.split(b"\n")
    return [(lines[at].decode(), not mark) for at, mark in zip(found.at.tolist(), field.decode(found.bins))]


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
