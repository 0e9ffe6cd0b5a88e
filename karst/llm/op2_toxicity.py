"""Toxicity of texts behind a noisy channel.

What is read may not be what was written: letters stand as digits and signs (`1d10t`), apart
(`i d i o t`, `i-d-i-o-t`) or repeated (`idiooot`). Words that show such signs become a lattice of
what each character can stand for; a Viterbi search under a character trigram model finds the
likeliest reading, and the score is taken of that. Other words have one reading only, themselves.

The model is two tables, both of bounded size: log-probabilities of 38**3 trigrams (letters,
digits, other letters, space), and words and word beginnings with the
log-odds that they add, which are some of those of the bounded sample below. Trigrams are counted over all texts outside the held-out
fold, labelled or not. Features are fitted on a bounded sample: at most about SAMPLE_EACH labelled
rows of each label, chosen by a hash of the id. A feature is taken only if its
count differs from the base rate by more than chance over all features tried (Bonferroni); texts
that nearly repeat each other count once. A text's score is the logistic function of c plus the
log-odds of its distinct words that are features; c is the likeliest for the sample.

Labels, lang, source and doc_id are no inputs of a score. Null and empty texts get the score of c,
which is below 0.5. A document with several labels counts as toxic if one says so. Rows are independent:
repeated rows give repeated results, an empty table none; without labels all scores are 0. Extra
columns are kept by `mark` and ignored by `score`. Whole texts are read, and no row is shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.common import cut, id_mod, own_cache

SAMPLE_EACH = 6000
PREFIXES = (4, 5, 6)
CACHE_WORDS = 200_000
ROWS_AT_ONCE = 500
#: What a sign can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Costs in the channel (natural logarithms): a sign for a letter, one of a doubled letter left out,
#: a sign that is no letter, a space between single letters kept.
SIGN, HALVE, BREAK, KEEP = 1.0, 1.5, 6.0, 2.0

_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
SPACE, OTHER = 36, 37
ALPHABET = 38
_CODE = {c: i for i, c in enumerate(_LETTERS)} | {" ": SPACE}
_NOISE = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_APART = re.compile(r"(?:[\w@$!|+€£(][.\-_*~,]){2,}[\w@$!|+€£(]")
_WORD = re.compile(r"[^\W_]+")
_EDGES = ".,;:?\"'()[]{}<>-_~`/\\#%&=^"
_SIGNS = re.compile("[" + re.escape("".join(LEET)) + "]")
_LETTER = re.compile(r"[^\W\d_]")


def _code(c: str) -> int:
    return _CODE.get(c, OTHER if c.isalpha() else SPACE)


def trigram_counts(words: list[str], times: np.ndarray) -> np.ndarray:
    """Counts of trigrams over words, each between spaces."""
    if not words:
        return np.zeros(ALPHABET**3)
    points, at = np.unique(np.frombuffer("".join(f"  {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    codes = np.array([_code(chr(p)) for p in points], np.int64)[at]
    size = np.array([len(w) + 3 for w in words])
    ends = np.cumsum(size)
    inside = np.ones(len(codes), bool)  # whether a trigram that begins here ends in the same word
    inside[ends - 1] = inside[ends - 2] = False
    first = np.flatnonzero(inside)
    grams = (codes[first] * ALPHABET + codes[first + 1]) * ALPHABET + codes[first + 2]
    return np.bincount(grams, weights=np.repeat(times, size - 2), minlength=ALPHABET**3)


def log_trigrams(counts: np.ndarray, strength: float = 20.0) -> np.ndarray:
    """Smoothed log P(third | first two): each order is the prior of the next."""
    c3 = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
    c1 = c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + ALPHABET)
    c2 = c3.sum(0)
    p2 = (c2 + strength * p1) / (c2.sum(1, keepdims=True) + strength)
    p3 = (c3 + strength * p2) / (c3.sum(2, keepdims=True) + strength)
    return np.log(p3)


class Channel:
    """Finds the likeliest reading of words under the character model."""

    def __init__(self, log_p: np.ndarray):
        self.log_p = log_p.tolist()

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """Viterbi over steps of (emission, cost); a state is the last two characters."""
        p = self.log_p
        best: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(SPACE, SPACE): (0.0, None, "")}
        for step in [*lattice, [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
            for (a, b), here in best.items():
                for text, cost in step:
                    x, y, score = a, b, here[0] - cost
                    for c in text:
                        k = _code(c)
                        if k == SPACE and y == SPACE:
                            continue
                        score += p[x][y][k]
                        x, y = y, k
                    old = after.get((x, y))
                    if old is None or score > old[0]:
                        after[x, y] = (score, here, text)
            best = after
        node: tuple | None = max(best.values(), key=lambda n: n[0])
        out = []
        while node is not None:
            out.append(node[2])
            node = node[1]
        return "".join(reversed(out)).strip()

    @staticmethod
    def lattice(text: str) -> list[list[tuple[str, float]]]:
        """What each run of equal characters can stand for."""
        out = []
        at = 0
        while at < len(text):
            c = text[at]
            n = 1
            while at + n < len(text) and text[at + n] == c:
                n += 1
            at += n
            if c.isalpha():
                step = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, HALVE)] if n == 2 else [(c, 0.0), (c * 2, 0.0)]
            else:
                step = [(x * k, SIGN * k) for x in LEET.get(c, "") for k in ({1, min(n, 2)})]
                step.append((c * n, 0.0) if c.isdigit() else (" ", BREAK))
            out.append(step)
        return out

    def word(self, token: str) -> str:
        """The reading of one token in lower case."""
        t = _NOISE.sub("", token).strip(_EDGES)
        t = t.strip("!|*") if t[-1:] in "!|*" or t[:1] in "|*" else t
        if len(t) < 2 or not _LETTER.search(t):
            return t
        if _APART.fullmatch(t):
            return self.apart([x for x in re.split(r"[.\-_*~,]", t) if x])
        if _SIGNS.search(t) or _REPEAT.search(t):
            return self.decode(self.lattice(t))
        return t

    def apart(self, singles: list[str]) -> str:
        """The reading of single characters that stand apart."""
        steps: list[list[tuple[str, float]]] = []
        for s in singles:
            if steps:
                steps.append([("", 0.0), (" ", KEEP)])
            steps += self.lattice(s)
        return self.decode(steps)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, len(b), rows))


def _tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens in lower case as found, the number of each token, and where texts begin."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return words, coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()


def _single_runs(words: list[str], k: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first, last + 1) of three or more single characters in a row."""
    if not len(k):
        return []
    single = np.array([len(w.strip(".,;:-_")) == 1 and len(w) < 3 and (w[0].isalnum() or w[0] in LEET) for w in words], bool)[k]
    ends = np.zeros(len(k) + 1, bool)
    ends[starts[:-1]] = True
    at = np.flatnonzero(single)
    if not len(at):
        return []
    new = np.concatenate([[True], (np.diff(at) > 1) | ends[at[1:]]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    owner = np.searchsorted(starts, at[first], "right") - 1
    return [(int(o), int(at[f]), int(at[f] + n)) for o, f, n in zip(owner, first, size) if n >= 3]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700))) * (x > -700)


@dataclass
class Model:
    log_p: np.ndarray
    weight: dict[str, float]  # word, or "beginning*": log-odds that it adds
    base: float  # log-odds of a text without a feature
    channel: Channel = field(init=False)
    cache: dict[str, float] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.channel = Channel(self.log_p)

    def word_weight(self, word: str) -> float:
        found = self.weight.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                found = max(found, self.weight.get(word[:n] + "*", 0.0))
        return found

    def reading_weight(self, reading: str) -> tuple[tuple[str, float], ...]:
        return tuple((w, s) for w in _WORD.findall(reading) if (s := self.word_weight(w)) > 0)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of texts (null as empty)."""
        texts = pc.fill_null(texts, "")
        words, k, starts = _tokens(texts)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, hits = self.cache, []
        for w in words:
            got = cache.get(w)
            if got is None:
                got = cache[w] = self.reading_weight(self.channel.word(w))
            hits.append(got)
        found: dict[int, dict[str, float]] = {}
        some = np.array([bool(h) for h in hits], bool)
        at = np.flatnonzero(some[k]) if len(k) else np.zeros(0, np.int64)
        for owner, token in zip(np.searchsorted(starts, at, "right") - 1, k[at]):
            found.setdefault(int(owner), {}).update(hits[token])
        for owner, a, b in _single_runs(words, k, starts):
            reading = self.channel.apart([words[x].strip(".,;:-_") for x in k[a:b]])
            for w, s in self.reading_weight(reading):
                found.setdefault(owner, {})[w] = s
        odds = np.full(len(texts), self.base)
        for owner, own in found.items():
            odds[owner] += sum(own.values())
        return logistic(odds)

    def restore(self, text: str | None) -> str:
        """The text as it is scored: each word's likeliest reading."""
        words, k, starts = _tokens(pa.array([text or ""]))
        runs = {a: b for _, a, b in _single_runs(words, k, starts)}
        out, i = [], 0
        while i < len(k):
            if i in runs:
                out.append(self.channel.apart([words[x].strip(".,;:-_") for x in k[i : runs[i]]]))
                i = runs[i]
            else:
                out.append(self.channel.word(words[k[i]]))
                i += 1
        return " ".join(x for x in out if x)


#: Copies would make a word look like proof: texts of one label whose sketches agree in ALIKE of the numbers count once.
_SEEDS = np.random.default_rng(5).integers(1, 2**63, 8).astype(np.uint64)
ALIKE = 3

NO_MODEL = Model(log_trigrams(np.zeros(ALPHABET**3)), {}, -math.inf)


def _sample(labels: DataFrame, modulus: int, held_out: int) -> tuple[DataFrame, dict[int, float]]:
    """About SAMPLE_EACH ids of each label, with how many rows each stands for."""
    told = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.filter(id_mod("doc_id", modulus) != held_out).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    sizes = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    keep = {k: min(1.0, SAMPLE_EACH / n) for k, n in sizes.items()}
    share = F.when(F.col("toxic") == 1, F.lit(keep.get(1, 1.0))).otherwise(F.lit(keep.get(0, 1.0)))
    chosen = told.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) < share * 1_000_003)
    return chosen, {k: 1 / keep[k] for k in keep}


def _originals(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Of (hash, label, sketch) in order those that are no copy of one before with the same label: sketches differ in most numbers."""
    out: list[tuple[int, int, bytes]] = []
    for label in (0, 1):
        own = [r for r in rows if r[1] == label]
        kept, n = np.zeros((len(own), len(_SEEDS)), np.uint64), 0
        for r in own:
            x = np.frombuffer(r[2], np.uint64)
            if not n or ((kept[:n] == x).sum(1) < ALIKE).all():
                kept[n] = x
                n += 1
                out.append(r)
    return out


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Model:
    """Count the character model on all texts outside the held-out fold, and fit the features on the labelled sample."""
    chosen, weight = _sample(labels, modulus, held_out)
    # at most about 2 * SAMPLE_EACH ids: a bounded broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3)
        own_cache("op2")
        for b in _slices(batches):
            words, k, _ = _tokens(b.column(0))
            plain = [i for i, w in enumerate(words) if not _SIGNS.search(w)]
            times = np.bincount(k, minlength=len(words))[plain].astype(float) if plain else np.zeros(0)
            total += trigram_counts([words[i].strip(_EDGES) for i in plain], times)
        at = np.flatnonzero(total)  # once a task
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], ["k", "n"])

    counts = np.zeros(ALPHABET**3)
    seen = docs.filter(id_mod("doc_id", modulus) != held_out).select(F.coalesce("text", F.lit("")).alias("text"))
    for r in seen.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    log_p = log_trigrams(counts)
    shared = docs.sparkSession.sparkContext.broadcast(log_p)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, cache = Channel(shared.value), {}
        own_cache("op2")
        for b in _slices(batches):
            words, k, starts = _tokens(b.column(0))
            runs = _single_runs(words, k, starts)
            crc = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
            own, sketch = [], []
            for i in range(len(b)):
                mine = k[starts[i] : starts[i + 1]]
                got: set[str] = set()
                for x in np.unique(mine):
                    w = words[x]
                    if w not in cache:
                        if len(cache) > CACHE_WORDS:
                            cache.clear()
                        cache[w] = [
                            f for r in _WORD.findall(channel.word(w)) if len(r) > 2 and not r.isdigit()
                            for f in (r, *[r[:n] + "*" for n in PREFIXES if len(r) > n])
                        ]
                    got.update(cache[w])
                for o, a, z in runs:
                    if o == i:
                        got.update(r for r in _WORD.findall(channel.apart([words[x].strip(".,;:-_") for x in k[a:z]])) if len(r) > 2)
                own.append(sorted(got))
                x = crc[mine]
                for _ in range(2 if len(mine) > 2 else 0):
                    x = (x[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
                    x = x ^ (x >> np.uint64(29))
                x = (x[None, :] ^ _SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                sketch.append((x.min(1) if x.size else _SEEDS).tobytes())
            cols = [b.column(1), b.column(2), pa.array(sketch, pa.binary()), pa.array(own, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["toxic", "h", "sketch", "own"])

    each = texts.select("text", "toxic", F.xxhash64("text").alias("h"))
    each = cut(each.mapInArrow(features, "toxic int, h long, sketch binary, own array<string>"), "features")
    # the sample is bounded, and so are its sketches; of equal texts the other rows go too
    told = sorted((r["h"], r["toxic"], bytes(r["sketch"])) for r in each.select("h", "toxic", "sketch").collect())
    alone = [(h, toxic) for h, toxic, _ in _originals(told)]
    alone = docs.sparkSession.createDataFrame(alone, "h long, toxic int")
    each = each.join(F.broadcast(alone), ["h", "toxic"]).dropDuplicates(["h", "toxic"])
    # each text also holds the empty feature, whose counts are those of the sample
    told = each.select("toxic", F.explode(F.concat("own", F.array(F.lit("")))).alias("f"))
    by = told.groupBy("f").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    all_ = by.filter("f = ''").collect()
    if not all_ or not all_[0]["pos"]:
        return Model(log_p, {}, -math.inf)
    pos, n = all_[0]["pos"], all_[0]["n"]
    if pos == n:
        return Model(log_p, {}, -0.04)
    b = pos / n
    tried = max(1, by.filter("n >= 2").count())
    q, total = F.col("pos") / F.col("n"), F.col("n")
    gain = F.col("pos") * F.log(q / b) + F.when(q < 1, (total - F.col("pos")) * F.log((1 - q) / (1 - b))).otherwise(0.0)
    picked = by.filter((F.col("f") != "") & (q > b) & (F.col("pos") >= 3)).filter(gain >= math.log(10 * tried))
    ratio = weight.get(0, 1.0) / weight.get(1, 1.0)
    share = F.col("pos") / (F.col("pos") + ratio * (total - F.col("pos") + 1))
    prior = pos / (pos + ratio * (n - pos))
    added = F.log(share / (1 - share)) - F.lit(math.log(prior / (1 - prior)))
    rows = picked.filter(share >= 0.5).select("f", added.alias("added")).collect()
    model = Model(log_p, {r["f"]: r["added"] for r in rows if r["added"] > 0}, 0.0)
    weights = docs.sparkSession.sparkContext.broadcast(model.weight)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(np.zeros((1, 1, 1)), weights.value, 0.0)
        for batch in batches:
            added = [round(sum(own.word_weight(w) for w in words if w[-1:] != "*"), 1) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(added, pa.float64())], ["toxic", "added"])

    # a histogram in steps of a tenth is all that the intercept needs
    seen = each.select("toxic", "own").mapInArrow(sums, "toxic int, added double").groupBy("toxic", "added").count().collect()
    added_, times = np.array([r["added"] for r in seen]), np.array([r["count"] * (1.0 if r["toxic"] else ratio) for r in seen])
    sign = np.array([1.0 if r["toxic"] else -1.0 for r in seen])
    grid = np.arange(-12.0, 0.0, 0.05)
    loss = [(times * np.logaddexp(0, -sign * (added_ + c))).sum() for c in grid]
    model.base = float(grid[int(np.argmin(loss))])
    return model


def _scored(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for b in _slices(batches):
            score = model.score(b.column(b.schema.get_field_index("text")))
            cols = [c for c, name in zip(b.columns, b.schema.names) if name != "__score"]
            names = [name for name in b.schema.names if name != "__score"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score, pa.float64())], [*names, "__score"])

    return run


def _model(shared) -> Model:
    """One model a process, so that its cache serves the tasks that follow."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else hash(shared._path)
    mine = own_cache("op2")
    if key not in mine:
        mine.clear()
        mine[key] = Model(*shared.value)
    return mine[key]


def _apply(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.log_p, model.weight, model.base))
    schema = T.StructType([*rows.schema.fields, T.StructField("__score", T.DoubleType())])
    return rows.mapInArrow(_scored(shared), schema)


def score(docs: DataFrame, model: Model, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_mod("doc_id", modulus) == held_out).alias("held_out"), "text")
    return _apply(rows, model).select(
        "doc_id", "held_out", F.col("__score").alias("score"), F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that aren't predicted toxic, with all their columns."""
    return _apply(docs, model).filter(F.col("__score") < 0.5).drop("__score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
