"""SentencePiece BPE encoding by suffix-array matching, and decoding.

Texts are escaped as the model wants it (a space before, spaces as U+2581) and cut where no piece
can reach over: before a run of spaces, and at line ends and tabs, which no piece holds. The
distinct parts of a batch that the cache lacks are written one after the other and indexed by a
suffix array over their character starts, sorted to the depth of the longest piece (no piece tells
more). Every piece is searched in it by bisection; the range found is the list of its occurrences.
All occurrences (edges from a place to a place) are sorted by position. Relaxation then follows the
model's rule: in each part, of all neighbouring symbols that an edge spans, the best-scored
(leftmost first) are joined, until no edge spans two symbols. Characters without a piece become
byte pieces.

Null counts as empty; an empty text has no ids. Rows are independent: repeated rows give repeated
results, an empty table none. Extra columns are ignored (`encode_column` keeps them). Whole texts
are encoded. A part of more than LONG symbols is relaxed through a heap, in n log n steps. One of
more than WINDOW bytes is worked in windows, so that memory beyond the text and its ids doesn't grow
with it: each window keeps the symbols that what follows it cannot change (see `settled`), and the
next one begins where they end; a window without such symbols is doubled. Runs of one letter or of a
few in turn settle like other text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.common import own_cache

MARK = "▁"
CACHE_PARTS = 450_000
GROUP_BYTES = 256 << 10
WINDOW = 128 << 10
LONG = 96
_END = b"\xff"  # in no UTF-8 text


class Pieces:
    """The vocabulary: pieces that can be matched, their ids and ranks, and byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        own = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes_of = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif sp.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
        for i in own:
            self.bytes_of[i] = sp.id_to_piece(i).encode()
        text = [self.bytes_of[i] for i in own]
        self.id = np.array(own, np.int32)
        self.size = np.array([len(x) for x in text], np.int64)
        self.rank = np.unique(np.array([sp.get_score(i) for i in own]), return_inverse=True)[1].astype(np.int32)
        self.longest = int(self.size.max())
        self.text = text
        # bounds of the first and the second eight bytes of the suffixes that begin with a piece
        low = [x.ljust(16, b"\0")[:16] for x in text]
        high = [x.ljust(16, b"\xff")[:16] for x in text]
        self.low = np.frombuffer(b"".join(low), ">u8").reshape(-1, 2).astype(np.uint64)
        self.high = np.frombuffer(b"".join(high), ">u8").reshape(-1, 2).astype(np.uint64)
        joined = "".join(sp.id_to_piece(i) for i in own)
        if any(c in joined for c in "\n\t "):
            raise ValueError("pieces with line ends, tabs or spaces aren't supported")


def suffix_array(buffer: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character starts in the order of their next `depth` bytes or more, and the first 16 of those bytes as two numbers."""
    words = -(-max(depth, 16) // 8)
    padded = np.concatenate([buffer, np.zeros(8 * words + 8, np.uint8)])
    at = np.flatnonzero((buffer & 0xC0) != 0x80)
    eight = np.zeros(len(buffer) + 8 * words, np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | padded[i : i + len(eight)]
    first = eight[at]
    order = np.argsort(first)
    at, first = at[order], first[order]
    same = first[1:] == first[:-1]
    for skip in range(8, 8 * words, 8):  # only suffixes that are still alike
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(tied):
            break
        run = np.cumsum(~np.append(False, same))[tied]
        own = at[tied]
        at[tied] = own[np.lexsort((eight[own + skip], run))]
        same &= eight[at[1:] + skip] == eight[at[:-1] + skip]
    return at, first, eight[at + 8]


def edges(buffer: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of all pieces, sorted by position: where, and the number of the piece."""
    at, first, second = suffix_array(buffer, pieces.longest)
    lo = np.searchsorted(first, pieces.low[:, 0], "left")
    hi = np.searchsorted(first, pieces.high[:, 0], "right")
    raw = buffer.tobytes()
    extra_at: list[np.ndarray] = []
    extra_piece: list[np.ndarray] = []
    for p in np.flatnonzero((pieces.size > 8) & (hi > lo)):
        a, b = lo[p], hi[p]
        lo[p] = a + np.searchsorted(second[a:b], pieces.low[p, 1], "left")
        hi[p] = a + np.searchsorted(second[a:b], pieces.high[p, 1], "right")
        if pieces.size[p] > 16 and hi[p] > lo[p]:
            text, n = pieces.text[p], int(pieces.size[p])
            good = [x for x in at[lo[p] : hi[p]].tolist() if raw[x : x + n] == text]
            extra_at.append(np.array(good, np.int64))
            extra_piece.append(np.full(len(good), p, np.int64))
            hi[p] = lo[p]
    n = hi - lo
    total = np.cumsum(n)
    where = at[np.arange(total[-1]) + np.repeat(lo - (total - n), n)]
    piece = np.repeat(np.arange(len(n)), n)
    where, piece = np.concatenate([where, *extra_at]), np.concatenate([piece, *extra_piece])
    order = np.argsort(where.astype(np.int32), kind="stable")
    return where[order], piece[order]


def _relax_long(
    starts: list[int], end: int, found: np.ndarray, width: int, rank: np.ndarray, more: bool = False
) -> tuple[list[int], list[int]]:
    """Starts and ends of the symbols of one long part: joins through a heap.

    `more`: the part goes on after `end`. Only symbols that this cannot change are returned.
    """
    n = len(starts)
    begin, stop = array("q", starts), array("q", starts[1:])
    stop.append(end)
    nxt, prev, live = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), bytearray(b"\1" * n)
    heap: list[int] = []  # cost, symbol and length of a join in one number
    top = len(rank)
    last, until_here, reached, worst = n - 1, end, end + 1, -len(rank) - 1

    def settled() -> None:
        """Move until_here left while an edge of the symbol before it spans it and may be joined by now.

        What lies beyond is unknown, but for one thing: symbols only grow, so the one that begins at
        until_here ends at `reached` or later, where it ended when it was last known. An edge that
        ends before joins nothing; so a run of equal letters settles. Joins are made in the order of
        their costs (negative ranks) and places, but for joins that others make possible; so while
        no join has cost more than `worst`, a join over until_here that costs as much or more is
        still to come.
        """
        nonlocal last, until_here, reached
        while last >= 0:
            own = found[begin[last] * width + reached - begin[last] : (begin[last] + 1) * width]
            own = own[own >= 0]
            if not len(own) or -int(rank[own].max()) >= worst:
                return
            until_here, reached = begin[last], stop[last]
            last = prev[last]

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and stop[j] - begin[i] < width:
            p = found[begin[i] * width + stop[j] - begin[i]]
            if p >= 0:
                heapq.heappush(heap, ((top - int(rank[p])) * n + i) * width + stop[j] - begin[i])

    for i in range(n - 1):
        offer(i)
    while heap:
        rest, reach = divmod(heapq.heappop(heap), width)
        cost, i = divmod(rest, n)
        cost -= top
        j = nxt[i] if live[i] else n
        if j >= n or stop[j] - begin[i] != reach:
            continue
        if more and cost > worst:
            worst = cost
            settled()
        if more and i == last:  # joined with what isn't known for sure
            until_here, reached, last = begin[i], stop[i], prev[i]
            settled()
        stop[i], live[j], nxt[i] = stop[j], 0, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        if more and j == last:
            last = i
            settled()
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    if more:
        worst = 1
        settled()
    return [b for b, ok in zip(begin, live) if ok and b < until_here], [e for e, b, ok in zip(stop, begin, live) if ok and b < until_here]


def encode_long(part: str, pieces: Pieces, window: int = WINDOW) -> np.ndarray:
    """Ids of one part, window by window."""
    raw = np.frombuffer(part.replace(" ", MARK).encode("utf-8", "replace"), np.uint8)
    width, out, at, size = pieces.longest + 1, [], 0, window
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        buffer = raw[at : end + width]
        found = np.full((len(buffer) + 1) * width, -1, np.int32)
        where, piece = edges(buffer, pieces)
        whole = where + pieces.size[piece] <= len(buffer)
        found[where[whole] * width + pieces.size[piece[whole]]] = piece[whole]
        starts = np.flatnonzero((buffer[: end - at] & 0xC0) != 0x80).tolist()
        begin, stop = (np.array(x, np.int64) for x in _relax_long(starts, end - at, found, width, pieces.rank, end < len(raw)))
        if not len(begin):
            size *= 2
            continue
        ids, _ = _ids_of(begin, stop, np.zeros(len(begin), np.int64), buffer, found, pieces)
        out.append(ids)
        at, size = at + int(stop[-1]), window
    return np.concatenate([*out, np.zeros(0, np.int32)])


def _ids_of(
    begin: np.ndarray, stop: np.ndarray, owner: np.ndarray, buffer: np.ndarray, found: np.ndarray, pieces: Pieces
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols, and whose they are: a symbol that is no piece is spelled in byte pieces."""
    width = pieces.longest + 1
    which = found[begin * width + np.minimum(stop - begin, width - 1)]
    which = np.where(stop - begin < width, which, -1)
    unknown = np.flatnonzero(which < 0)
    ids = np.where(which >= 0, pieces.id[which], -1).astype(np.int32)
    if len(unknown):
        n = np.ones(len(ids), np.int64)
        n[unknown] = (stop - begin)[unknown]
        wide = np.repeat(ids, n)
        spot = np.repeat(np.cumsum(n) - n, n)
        spelled = np.flatnonzero(wide < 0)
        offset = np.arange(len(wide)) - spot
        wide[spelled] = pieces.byte_ids[buffer[np.repeat(begin, n)[spelled] + offset[spelled]]]
        ids, owner = wide, np.repeat(owner, n)
    return ids, owner


def encode_parts(parts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts in turn, and how many each has."""
    raws = [p.replace(" ", MARK).encode("utf-8", "replace") for p in parts]
    buffer = np.frombuffer(_END.join(raws) + _END, np.uint8)
    width = pieces.longest + 1
    where, piece = edges(buffer, pieces)
    found = np.full(len(buffer) * width, -1, np.int32)
    found[where * width + pieces.size[piece]] = piece
    is_end = buffer == 0xFF
    begin = np.flatnonzero(((buffer & 0xC0) != 0x80) & ~is_end)
    part = np.cumsum(is_end)[begin]
    stop = np.append(begin[1:], len(buffer) - 1)
    last = np.append(part[1:] != part[:-1], True)
    stop[last] = np.flatnonzero(is_end)[part[last]]
    symbols = np.bincount(part, minlength=len(parts))
    done_begin: list[np.ndarray] = []
    done_stop: list[np.ndarray] = []
    long_ = symbols > LONG
    for p in np.flatnonzero(long_):
        own = part == p
        b, e = _relax_long(begin[own].tolist(), int(stop[own][-1]), found, width, pieces.rank)
        done_begin.append(np.array(b, np.int64))
        done_stop.append(np.array(e, np.int64))
    keep = ~long_[part]
    begin, stop, part = begin[keep], stop[keep], part[keep]
    while len(begin):
        reach = np.append(stop[1:], 0) - begin
        ok = np.append(part[1:] == part[:-1], False) & (reach < width)
        own = found[np.where(ok, begin * width + reach, 0)]
        rank = np.where(ok & (own >= 0), pieces.rank[own], -1)
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sizes = np.diff(np.append(heads, len(part)))
        best = np.repeat(np.maximum.reduceat(rank, heads), sizes)
        stuck = best < 0
        if stuck.any():
            done_begin.append(begin[stuck])
            done_stop.append(stop[stuck])
        hit = np.flatnonzero((rank == best) & ~stuck)
        hit = hit[np.append(True, part[hit][1:] != part[hit][:-1])] if len(hit) else hit  # the leftmost of a part
        stop[hit] = stop[hit + 1]
        live = ~stuck
        live[hit + 1] = False
        begin, stop, part = begin[live], stop[live], part[live]
    begin, stop = np.concatenate([*done_begin, np.zeros(0, np.int64)]), np.concatenate([*done_stop, np.zeros(0, np.int64)])
    order = np.argsort(begin, kind="stable")
    begin, stop = begin[order], stop[order]
    owner = np.cumsum(is_end)[begin] if len(begin) else np.zeros(0, np.int64)
    ids, owner = _ids_of(begin, stop, owner, buffer, found, pieces)
    return ids, np.bincount(owner, minlength=len(parts))


class Encoder:
    """Encodes texts through a cache of their parts."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.cut = re.compile(r"\n|\t| +[^ \n\t]*|[^ \n\t]+")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.int32)
        self.starts = np.zeros(1 << 20, np.int64)
        self.used = 0

    def _learn(self, parts: list[str]) -> None:
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size < GROUP_BYTES):
                size += len(parts[end]) * (1 if parts[end].isascii() else 3)
                end += 1
            ids, n = encode_parts(parts[at:end], self.pieces)
            have = len(self.index)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while have + len(n) >= len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[have + 1 : have + 1 + len(n)] = self.used + np.cumsum(n)
            self.used += len(ids)
            self.index.update(zip(parts[at:end], range(have, have + len(n))))
            at = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        cut, index = self.cut.findall, self.index
        parts = [cut(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(x for own in parts for x in own) if p not in index]
        long_: dict[str, np.ndarray] = {}  # too large to be kept
        if new:
            if max(map(len, new)) > WINDOW // 4:
                long_ = {p: encode_long(p, self.pieces) for p in new if len(p) > WINDOW // 4}
                new = [p for p in new if p not in long_]
            if len(index) > CACHE_PARTS:
                self.clear()
                index = self.index
                new = [p for p in dict.fromkeys(x for own in parts for x in own) if p not in long_]
            self._learn(new)
        out = []
        for own in parts:
            if long_ and any(p in long_ for p in own):
                out.append(np.concatenate([long_[p] if p in long_ else self._known([p]) for p in own]))
            else:
                out.append(self._known(own))
        return out

    def _known(self, parts: list[str]) -> np.ndarray:
        k = np.array(list(map(self.index.__getitem__, parts)), np.int64)
        begin = self.starts[k]
        size = self.starts[k + 1] - begin
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        return self.ids[np.arange(n) + np.repeat(begin - (total - size), size)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        of, step = self.pieces.bytes_of.__getitem__, 1 << 18
        raw = b"".join(b"".join(map(of, ids[i : i + step].tolist())) for i in range(0, len(ids), step))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text




def encoder_for(path: str) -> Encoder:
    """One encoder a process, so that its cache serves the tasks that follow."""
    mine = own_cache("op6")
    if path not in mine:
        mine[path] = Encoder(path)
    return mine[path]


SLICE = 1000


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """The rows with all their columns, and ids, n_tokens, ids_crc32 and whether decoding gives the text again."""
    names = ["ids", "n_tokens", "ids_crc32", "round_trip"]
    kept = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                b = whole.slice(at, SLICE)
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                ids = encoder.encode(texts)
                same = [encoder.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts)]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
                new = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array(same, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    schema = T.StructType(
        [
            *kept,
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def decode_column(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of the rows' ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for b in batches:
            texts = [encoder.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def run(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, round_trip of every document; one pass without a shuffle."""
    return encode_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path).drop("text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return run(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
