"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its byte n-grams (2 to 4 bytes, A-Z in lower case),
each found by its hash among BUCKETS rows; a linear softmax over the average gives the languages.
Embeddings and softmax are trained together by stochastic gradient descent in numpy, on whole
texts and on short pieces of them. A part of the sample is kept from training and fits the
softmax's temperature and the score below which a prediction is marked `rejected`: the least for
which the predictions above it reach TARGET accuracy there, and at least the one that a share of
REJECTED of the right predictions there fall below, so that texts of no learned language and
mixtures are told even where all kept rows are predicted right.

The fit takes a bounded sample: about SAMPLE_ROWS rows in all, equally many of each language,
chosen by the hash of id and text. As both maps are linear, prediction needs their product alone,
a table of BUCKETS x languages, which is the only thing that is broadcast.

Null texts and texts without a letter get `und` with score 0, as do all where nothing could be
learned. Null languages are not learned. Rows are independent: repeated rows give repeated
results, an empty table none. Extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import id_mod

BUCKETS = 1 << 15
DIM = 16
SIZES = (2, 3, 4)
SAMPLE_ROWS = 2400
EPOCHS, RATE, BATCH = 5, 4.0, 64
PIECES = (12, 3)  # words of the short pieces that are learned besides a whole text
TARGET = 0.99
REJECTED = 0.005
CHUNK_BYTES = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint32([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F])


def _codes(raw: np.ndarray) -> list[np.ndarray]:
    """The bucket of the n-gram at each byte, for each size; the last size-1 places are left out."""
    b = raw.astype(np.uint32) + np.uint32(1)
    out, h = [], b * _MIX[0]
    for k in range(1, max(SIZES)):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[k % 4] + b[k:]
        if k + 1 in SIZES:
            x = h ^ (h >> np.uint32(13))
            out.append(((x * _MIX[1]) >> np.uint32(17)).astype(np.int64) % BUCKETS)
    return out


def _prepared(text: str | None) -> bytes:
    return b" " + (text or "").encode("utf-8", "replace").lower() + b" "


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    raw = np.frombuffer(_prepared(text), np.uint8)
    return np.unique(np.concatenate(_codes(raw)), return_counts=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Logits of each text, CHUNK_BYTES at a time."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        raws = [_prepared(t) for t in texts]
        while at < len(raws):
            end, size = at, 0
            while end < len(raws) and (end == at or size + len(raws[end]) <= CHUNK_BYTES):
                size += len(raws[end])
                end += 1
            lengths = np.array([len(r) for r in raws[at:end]], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            joined = np.frombuffer(b"".join(raws[at:end]) + bytes(max(SIZES)), np.uint8)
            total, n = np.zeros((end - at, len(self.langs))), np.zeros(end - at)
            for size_, code in zip(SIZES, _codes(joined)):
                # n-grams that reach over the end of their text count as nothing
                for back in range(1, size_):
                    code[starts + lengths - back] = BUCKETS
                total += np.add.reduceat(self._padded[code[: size]], starts, axis=0)
                n += np.maximum(lengths - size_ + 1, 0)
            out[at:end] = total / np.maximum(n, 1)[:, None] + self.bias
            at = end
        return out

    def __post_init__(self):
        self._padded = np.vstack([self.table, np.zeros((1, self.table.shape[1]), self.table.dtype)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether the score is too low to be trusted."""
        if not texts or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = self.probabilities(self.logits(texts))
        best = p.argmax(1)
        known = np.array([t is not None and _LETTER.search(t) is not None for t in texts])
        score = np.where(known, p.max(1), 0.0)
        return [self.langs[k] if ok else "und" for k, ok in zip(best, known)], score, score < self.reject_below


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], langs: list[str], seed: int = 1) -> Model:
    """Fit on (language number, buckets, counts). Every tenth row is kept for calibration."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    emb = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    out = np.zeros((DIM, k), np.float32)
    bias = np.zeros(k, np.float32)
    fit = [r for i, r in enumerate(rows) if i % 10] or rows
    held = rows[::10]

    def average(some):
        at = np.concatenate([r[1] for r in some])
        weight = np.concatenate([r[2] / r[2].sum() for r in some]).astype(np.float32)
        starts = np.concatenate([[0], np.cumsum([len(r[1]) for r in some])[:-1]])
        return at, weight, np.add.reduceat(emb[at] * weight[:, None], starts, axis=0)

    steps, done = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for i in range(0, len(fit), BATCH):
            some = [fit[j] for j in order[i : i + BATCH]]
            at, weight, x = average(some)
            z = x @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), [r[0] for r in some]] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ out.T
            out -= rate * (x.T @ p) / len(some)
            bias -= 0.1 * rate * p.mean(0)
            step = np.repeat(back, [len(r[1]) for r in some], axis=0) * weight[:, None]
            order_ = np.argsort(at, kind="stable")
            sorted_ = at[order_]
            first = np.flatnonzero(np.diff(sorted_, prepend=-1))
            emb[sorted_[first]] -= rate * np.add.reduceat(step[order_], first, axis=0)
            done += 1
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(float), 1.0, 0.0)
    if held:
        z = np.concatenate([average(held[i : i + 256])[2] @ out + bias for i in range(0, len(held), 256)])
        y = np.array([r[0] for r in held])
        rows_ = np.arange(len(y))
        grid = np.geomspace(0.05, 20, 60)

        def loss(t):
            model.temperature = t
            return -np.log(np.maximum(model.probabilities(z)[rows_, y], 1e-12)).mean()

        model.temperature = float(min(grid, key=loss))
        p = model.probabilities(z)
        score, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-score, kind="stable")
        accuracy = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(accuracy >= TARGET)
        model.reject_below = float(max(score[order][good[-1]], np.quantile(score[right], REJECTED))) if len(good) else 1.0
    return model


def _pieces(doc_id, text: str) -> list[str]:
    """A text and short pieces of it from a place that its own content chooses."""
    w = text.split()
    out = [text]
    for n in PIECES:
        if len(w) > n:
            at = (len(text) * 7919) % (len(w) - n)
            out.append(" ".join(w[at : at + n]))
    return out


def fit(docs: DataFrame, modulus: int = 3, held_out: int = 1, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from text and lang of the rows whose id isn't held out."""
    rows = docs.select("text", "lang", id_mod("doc_id", modulus).alias("m"), F.xxhash64("doc_id", F.xxhash64("text")).alias("h"))
    rows = rows.filter((F.col("m") != held_out) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    each = max(1, sample_rows // len(langs))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / sizes[lang]))).otherwise(share)
    chosen = rows.filter(F.pmod(F.col("h"), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text", "h")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for lang, text, h in zip(*(c.to_pylist() for c in b.columns)):
                for i, piece in enumerate(_pieces(h, text)):
                    if _LETTER.search(piece):
                        at, n = counts(piece)
                        got.append((lang, h, i, at.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
            cols = list(zip(*got)) if got else [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["lang", "h", "i", "at", "n"])

    got = chosen.mapInArrow(features, "lang string, h long, i int, at binary, n binary").collect()
    got.sort(key=lambda r: (r["h"], r["i"], r["lang"]))
    number = {lang: i for i, lang in enumerate(langs)}
    data = [(number[r["lang"]], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4").astype(np.float32)) for r in got]
    return train(data, langs) if data else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)


def predict(docs: DataFrame, model: Model, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.bias, model.temperature, model.reject_below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            lang, score, rejected = m.predict(b.column(2).to_pylist())
            cols = [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_mod("doc_id", modulus) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
