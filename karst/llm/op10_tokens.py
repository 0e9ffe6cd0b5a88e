"""Token ids in fixed-width bit-packed files.

Each id takes the fewest bits that hold the vocabulary. A file is a run of segments; a segment is

    magic, version, bits, partition, sequence number, documents, ids, ids per block, data bytes
    doc_id of each document (int64), whether it is null (uint8), ids of each document (uint32)
    byte offset of each block (uint64)
    blocks: 64 ids fill exactly `bits` 64-bit words, little end first

so any run of ids is found by its block offset and unpacked with numpy, without the rest.

Texts: null counts as empty; an empty text has the end id alone. Rows with equal doc_id follow the
order of a 64-bit hash of their texts, then that of the texts; null doc_ids come first. An empty table gives no file and no row.
Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from karst.llm.common import cut, own_cache, parts_for, shared_path, text_bytes

MAGIC = b"KTOK"
HEAD = struct.Struct("<4sHHiIIQIQ")
BLOCK = 4096  # ids; a multiple of 64
PART_BYTES = 12 << 20
SLICE_BYTES = 16 << 20
PARTS_AT_ONCE = 1000  # whose totals are added up in one task
CACHE_WORDS = 800_000
JOIN = 100  # words encoded as one text
SPLIT = "<|startoftext|>"  # a special token of the vocabulary


def bits_for(vocab: int) -> int:
    """Fewest bits that hold ids 0 .. vocab-1."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit-pack ids; the last group of 64 is filled with zeros."""
    n = -(-len(ids) // 64) * 64
    rows = np.zeros(n, np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(-1, 64)
    out = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    rows = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(rows), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:n].astype(np.uint32)


def segment(part: int, seq: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One segment as bytes."""
    data = pack(ids, bits)
    offsets = np.arange(0, len(ids), BLOCK, dtype="<u8") // 64 * bits * 8
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, 1, bits, part, seq, len(doc_ids), len(ids), BLOCK, len(data))
    return b"".join([head, keys.tobytes(), null.tobytes(), np.asarray(lengths, "<u4").tobytes(), offsets.astype("<u8").tobytes(), data])


class Segment:
    """Random access to one segment of a file's bytes."""

    def __init__(self, raw: bytes | memoryview, at: int = 0):
        magic, version, self.bits, self.part, self.seq, n, self.n_ids, self.block, size = HEAD.unpack_from(raw, at)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment")
        p = at + HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", n, p)
        self.null = np.frombuffer(raw, np.uint8, n, p + 8 * n)
        self.lengths = np.frombuffer(raw, "<u4", n, p + 9 * n)
        k = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(raw, "<u8", k, p + 13 * n)
        self.data = memoryview(raw)[p + 13 * n + 8 * k :][:size]
        self.end = p + 13 * n + 8 * k + size
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop-1, from the blocks that hold them only."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        lo = int(self.offsets[a])
        hi = int(self.offsets[b]) if b < len(self.offsets) else len(self.data)
        n = min(b * self.block, self.n_ids) - a * self.block
        return unpack(self.data[lo:hi], self.bits, n)[start - a * self.block : stop - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def segments(raw: bytes) -> Iterator[Segment]:
    """All segments of a file; the writer puts a line feed after each."""
    at = 0
    while at < len(raw):
        s = Segment(raw, at)
        yield s
        at = s.end + 1


class WordEncoder:
    """Encodes texts through a cache of their parts between ASCII white space.

    The vocabulary's patterns never match across white space, and white space has no id, so the
    ids of a text are those of its parts in turn. Arrow splits a batch of texts and numbers its
    distinct parts; only parts that the cache lacks reach the library. The cache is emptied when full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.many = self.tokenizer.encode_batch_fast
        self.split_id = self.tokenizer.token_to_id(SPLIT)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 20, np.int64)
        self.n = self.used = 0

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(counts) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.n + 1 : self.n + 1 + len(counts)] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.n += len(counts)

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks, JOIN of them as one text with a special token between."""
        plain = [w for w in words if "<|" not in w] if self.split_id is not None else []
        for i in range(0, len(plain), JOIN * 64):
            lines = [plain[j : j + JOIN] for j in range(i, min(i + JOIN * 64, len(plain)), JOIN)]
            texts = [SPLIT.join(x) + SPLIT for x in lines]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.many(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.split_id)
            self._add(ids[ids != self.split_id], np.diff(ends, prepend=-1) - 1)
        known = set(plain)
        odd = [w for w in words if w not in known]
        for w, e in zip(odd, self.many(odd, add_special_tokens=False)):
            self._add(np.array(e.ids, np.uint32), np.array([len(e.ids)]))
        self.index.update(zip(plain + odd, range(len(self.index), len(self.index) + len(words))))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, each with its end id; ids of each text."""
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.index.get, words))
        if None in at:
            if len(self.index) > CACHE_WORDS:
                self.clear()
            self.learn([w for w in words if w not in self.index])
            at = list(map(self.index.get, words))
        k = np.array(at, np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        begin = self.starts[k]
        size = self.starts[k + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        ends = total[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return np.insert(flat, ends[1:], np.uint32(end_id)), np.diff(ends) + 1


def encoder_for(path: str) -> WordEncoder:
    """One encoder a process, so that its cache serves the tasks that follow."""
    mine = own_cache("op10")
    if path not in mine:
        mine[path] = WordEncoder(path)
    return mine[path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE_BYTES at most; a longer text is a batch alone."""
    for b in batches:
        rows = max(1, len(b) * SLICE_BYTES // max(1, b.nbytes, SLICE_BYTES))
        yield from (b.slice(at, rows) for at in range(0, len(b), rows))


def _encode(path: str, vocab: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, bits, part = encoder_for(path), bits_for(vocab), TaskContext.get().partitionId()
        for seq, b in enumerate(_slices(batches)):
            ids, lengths = encoder.encode(b.column(1), end_id)
            raw = segment(part, seq, b.column(0).to_pylist(), lengths, ids, bits)
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["segment"])

    return run


def write_ids(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encode every text and write the files to `out`, in ascending doc_id order.

    Range partitions of about PART_BYTES follow each other in order; a file's number is that of
    its partition. Spark's text writer puts the bytes of each segment into the file as they are.
    """
    from tokenizers import Tokenizer

    vocab = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = parts_for(text_bytes(rows), PART_BYTES)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    packed = dealt.mapInArrow(_encode(tokenizer_path, vocab, end_id), "segment binary")
    packed.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", "\n").text(out)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0):
            for s in segments(memoryview(raw.as_buffer())):
                ids = s.ids(0, s.n_ids)
                n = len(s.doc_ids)
                crc = [zlib.crc32(ids[s.starts[i] : s.starts[i + 1]].astype("<u4").tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s.part] * n, pa.int32()),
                        pa.array([s.seq] * n, pa.int32()),
                        pa.array(s.doc_ids, pa.int64(), mask=s.null.astype(bool)),
                        pa.array(s.starts[:-1], pa.int64()),
                        pa.array(s.lengths.astype(np.int64), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    The files are read once; a row per segment gives the ids before it. The only window over all rows has one a thousand partitions.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = cut(
        files.mapInArrow(_decode, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"), "ids"
    )
    # ids before a segment: of its partition, of partitions before it in its thousand, and of thousands before it
    block = F.floor(F.col("part") / PARTS_AT_ONCE)
    sums = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n")).withColumn("block", block)
    upto = lambda window: F.sum("n").over(window) - F.col("n")
    segments_ = sums.select("part", "seq", upto(Window.partitionBy("part").orderBy("seq")).alias("a"))
    parts = sums.groupBy("block", "part").agg(F.sum("n").alias("n"))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n")).select("block", upto(Window.orderBy("block")).alias("c"))
    parts = parts.select("block", "part", upto(Window.partitionBy("block").orderBy("part")).alias("b")).join(blocks, "block")
    before = segments_.join(parts, "part").select("part", "seq", (F.col("a") + F.col("b") + F.col("c")).alias("before"))
    return rows.join(before, ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def run(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    out = shared_path(spark, "tokens")
    write_ids(docs, out, tokenizer_path, end_id)
    return read_ids(spark, out)


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return run(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
