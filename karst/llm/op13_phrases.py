"""Phrases whose words belong together, counted by compressed position bitmaps (as in SPAM).

Texts are cut into pieces and words, and dealt into shards. In a shard all words stand at places of
one line, with an empty place between pieces. A word's bitmap has a bit at each of its places; only
blocks of 16 places with a bit are kept. A phrase is extended by a word: its bitmap is shifted by
one place and ANDed with the word's bitmap in the blocks that both have, and the bits left are the
ends of the longer phrase, whose count is a popcount. No bit stands at the empty places, so no
phrase crosses pieces. Extension goes depth first over batches of first words.

Counts are sums over shards. Each round tells the shards what they may build on: words, then pairs,
that reach the least count over all shards, for no longer phrase can be frequent otherwise. A shard's
words or phrases go, sorted and packed, to buckets by their hash, a row for each bucket. A bucket adds
up what all shards sent and answers each shard with those of its own that are frequent, packed too.
The more tokens, the more buckets: one gets the rows of about BUCKET_TOKENS tokens at most. Answers
are joined to the shards by their number; nothing is broadcast, and no table of words or phrases is
ever in one place. Shards are written once, so that all rounds see the same ones. Frequent words get
numbers, low for the most frequent of a bucket, and phrases travel as those numbers.

Scores and the drop of phrases inside longer ones are joins of the table of frequent phrases with
itself, in decimals of 38 digits. The best of a language are taken in rounds, each keeping the best
`top` of groups of GROUP phrases.

Null and empty texts have no words; a null language is `und`. Rows count as often as they occur. An
empty table gives no rows. Extra columns are ignored. A shard is about SHARD_BYTES of text and the
text that passes it, so a very long text makes a shard of its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.llm.common import cut, parts_for

LEAST, LONGEST, TOP = 30, 4, 2000
COVERED = 80  # percent of a phrase's count that a longer one must have to stand for it
SHARD_BYTES = 8 << 20
BATCH = 1 << 16  # blocks that are extended at a time
BUCKET_TOKENS = 2 << 20
SENT = 1 << 20  # phrases that a shard sends at a time
GROUP = 50_000
BLOCK = 16

#: Bytes as words and pieces see them: A-Z in lower case, the ends of pieces as line feeds, tabs as spaces.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 10 if chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D else 32 if b == 9 else b for b in range(256)
)
#: lang_of, words, counts and codes are packed: moving them is what a round costs. Words are numbered by falling count.
SHARD = "shard long, langs array<string>, sizes array<long>, lang_of binary, words binary, counts binary, codes binary"
#: Words of a shard in a bucket: language, text, count and the steps between their numbers.
WORDS = "bucket int, shard long, langs array<string>, lang_of binary, words binary, counts binary, i binary"
#: Either what a shard is told (its frequent words and their numbers over all shards) or a frequent word.
FREQUENT_WORDS = "shard long, i binary, ids binary, id long, lang string, phrase string, f long"
#: Phrases of `len` words of a shard in a bucket: the numbers of their words, and their counts.
PHRASES = "bucket int, len int, shard long, items binary, counts binary"
#: Either what a shard is told (its frequent phrases) or a frequent phrase.
FREQUENT = "shard long, items binary, ids array<long>, f long"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with a line feed between pieces and at the end."""
    found = text.translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
    found.append(b"\n")
    return [w for w in found if w]


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def _word_list(raw: bytes) -> list[bytes]:
    """The words packed together; none holds a space."""
    joined = _unpacked(raw)
    return joined.split(b" ") if joined else []


def _numbers(a: np.ndarray) -> bytes:
    """Numbers from 0 packed: all their lowest bytes, then all the next ones, as far as any is set."""
    wide = (int(a.max(initial=0)).bit_length() + 7) // 8
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8).T[:wide]
    return bytes([wide]) + len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _read_numbers(raw: bytes) -> np.ndarray:
    wide, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n and wide:
        out[:, :wide] = np.frombuffer(pa.decompress(raw[9:], n * wide, "zstd", asbytes=True), np.uint8).reshape(wide, n).T
    return out.view("<i8").ravel()


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0)


def _shard(texts: dict[str, list[bytes]]) -> dict:
    """Words of texts by language, and their numbers in the order of the texts."""
    words, lang_of, sizes, codes, base = [], [], [], [], 0
    for i, some in enumerate(texts.values()):
        found = [w for t in some for w in tokens(t)]
        number = {w: k for k, w in enumerate(dict.fromkeys(found))}
        gap = number.pop(b"\n", len(number))
        code = np.fromiter((number.get(w, -1) for w in found), np.int64, len(found))
        code = np.where(code > gap, code - 1, code)
        codes.append(np.where(code < 0, -1, code + base).astype("<i4"))
        sizes.append(int((code >= 0).sum()))
        words += number
        lang_of.append(np.full(len(number), i, "<i4"))
        base += len(number)
    line = np.concatenate(codes)
    counts = np.bincount(line[line >= 0], minlength=base)
    by_count = np.argsort(-counts, kind="stable")
    rank = np.empty(base + 1, np.int64)
    rank[by_count], rank[-1] = np.arange(base), -1
    return {
        "langs": list(texts),
        "sizes": sizes,
        "lang_of": _numbers(np.concatenate(lang_of)[by_count]),
        "words": _packed(b" ".join([words[k] for k in by_count])),
        "counts": _numbers(counts[by_count]),
        "codes": _numbers(rank[line] + 1),  # 0 stands between pieces
    }


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Texts as rows of SHARD, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = number = 0

        def flush() -> pa.RecordBatch:
            row = {"shard": number, **_shard(held)}
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                raw = text.as_py()
                held.setdefault(lang.as_py(), []).append(raw)
                size += len(raw)
                if size >= shard_bytes:
                    yield flush()
                    held, size, number = {}, 0, number + 1
        if held:
            yield flush()

    rows = docs.filter(F.octet_length("text") > 0).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    # the numbers are given once, as the table is written
    made = rows.mapInArrow(run, SHARD).withColumn("shard", F.monotonically_increasing_id())
    return cut(made, "shards")


class Bitmaps:
    """The bitmaps of a shard's words that may be built on, by word and by block."""

    def __init__(self, codes: np.ndarray, usable: np.ndarray):
        self.usable = usable  # ascending numbers of words
        rank = np.full(int(max(codes.max(initial=-1), usable.max(initial=-1))) + 2, -1, np.int64)
        rank[usable] = np.arange(len(usable))
        at = rank[codes]  # -1, the gap, reads the last place, which is -1
        place = np.flatnonzero(at >= 0)
        word = at[place]
        order = np.argsort(word, kind="stable")
        word, place = word[order], place[order]
        block = place // BLOCK
        first = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        bit = np.left_shift(1, place % BLOCK).astype(np.uint16)
        self.word, self.block = word[first], block[first]
        self.mask = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        by_block = np.argsort(self.block, kind="stable")
        self.b_word, self.b_mask = self.word[by_block], self.mask[by_block]
        self.b_start = np.searchsorted(self.block[by_block], np.arange(len(codes) // BLOCK + 3))

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words, blocks and masks of runs of first words; a word is never in two."""
        start = np.flatnonzero(np.diff(self.word, prepend=-1))
        ends = np.append(start[1:], len(self.word))
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(ends, start[a] + BATCH, side="right")))
            some = slice(start[a], ends[b - 1])
            yield self.word[some], self.block[some], self.mask[some]
            a = b

    def extend(self, block: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For bitmaps, BATCH blocks at a time: entry, next word, block and mask of what follows."""
        for a in range(0, len(block), BATCH):
            wide = mask[a : a + BATCH].astype(np.uint32) << np.uint32(1)
            low, high = (wide & np.uint32(0xFFFF)).astype(np.uint16), (wide >> np.uint32(16)).astype(np.uint16)
            over = np.flatnonzero(high)
            entry = np.concatenate([np.arange(len(low)), over])
            shifted = np.concatenate([low, high[over]])
            at = np.concatenate([block[a : a + BATCH], block[a : a + BATCH][over] + 1])
            start = self.b_start[at]
            n = self.b_start[at + 1] - start
            each = np.repeat(np.arange(len(at)), n)
            other = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
            left = shifted[each] & self.b_mask[other]
            hit = np.flatnonzero(left)
            yield entry[each[hit]] + a, self.b_word[other[hit]], at[each[hit]], left[hit]

    def grow(self, first: np.ndarray, block: np.ndarray, mask: np.ndarray, longest: int, allowed: np.ndarray | None, least: int = 2):
        """(phrases, counts) of at least `least` words that begin with the bitmaps given; phrases as rows of words.

        allowed: sorted word * number of words + next word of the pairs that may occur; None allows all.
        """
        phrases, of = first[:, None], np.arange(len(first))
        v = len(self.usable)
        start = np.flatnonzero(np.diff(first, prepend=-1))
        of, phrases = np.cumsum(np.diff(first, prepend=-1) != 0) - 1, first[start][:, None]
        while phrases.shape[1] < longest and len(of):
            kept = [[], [], [], []]
            for entry, word, at, left in self.extend(block, mask):
                parent = of[entry]
                if allowed is not None:
                    pair = phrases[parent, -1] * v + word
                    where = np.searchsorted(allowed, pair)
                    ok = allowed[np.minimum(where, len(allowed) - 1)] == pair if len(allowed) else np.zeros(len(pair), bool)
                    parent, word, at, left = parent[ok], word[ok], at[ok], left[ok]
                for out, x in zip(kept, (parent, word, at, left)):
                    out.append(x)
            parent, word, block, mask = (np.concatenate(x) for x in kept) if kept[0] else (np.zeros(0, np.int64),) * 4
            child, of = np.unique(parent * v + word, return_inverse=True)
            phrases = np.hstack([phrases[child // v], (child % v)[:, None]]) if len(child) else np.zeros((0, phrases.shape[1] + 1), np.int64)
            if phrases.shape[1] >= least and len(child):
                yield phrases, np.bincount(of, np.bitwise_count(mask), minlength=len(child)).astype(np.int64)


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs with the places of its rows, ascending."""
    order = np.argsort(bucket, kind="stable")
    start = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(start, np.append(start[1:], len(order))):
        yield int(bucket[order[a]]), order[a:b]


def _words(table: DataFrame, buckets: int) -> DataFrame:
    """The words of all shards as rows of WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, langs, lang_of, words, counts = (c[k].as_py() for c in b.columns)
                texts, lang_of, counts = _word_list(words), _read_numbers(lang_of), _read_numbers(counts)
                bucket = np.fromiter(map(crc32, texts), np.int64, len(texts)) % buckets
                rows = [
                    (h, shard, langs, _numbers(lang_of[at]), _packed(b" ".join([texts[i] for i in at])), _numbers(counts[at]), _numbers(_steps(at)))
                    for h, at in _dealt(bucket)
                ]
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _names(WORDS))

    return table.select("shard", "langs", "lang_of", "words", "counts").mapInArrow(run, WORDS)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct key, ascending: the place of one of its rows and the sum of n; for each row, which key it has."""
    order = np.argsort(key)
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    of = np.empty(len(key), np.int64)
    of[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    return order[start], np.add.reduceat(n[order], start), of


def _add_words(least: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Rows of WORDS of a bucket to rows of FREQUENT_WORDS."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, numbers, words, lang, n = key[0].as_py(), {}, [], [], []
        for langs, lang_of, some, counts in zip(*(rows[c].to_pylist() for c in ("langs", "lang_of", "words", "counts"))):
            words.append(pa.array(_word_list(some), pa.string()))
            lang.append(np.array([numbers.setdefault(x, len(numbers)) for x in langs])[_read_numbers(lang_of)])
            n.append(_read_numbers(counts))
        ends = np.cumsum([len(x) for x in n])
        coded = pa.concat_arrays(words).dictionary_encode()
        lang, n = np.concatenate(lang), np.concatenate(n)
        one, f, of = _sums(lang * len(coded.dictionary) + coded.indices.to_numpy(), n)
        frequent = np.flatnonzero(f >= least)
        frequent = frequent[np.argsort(-f[frequent], kind="stable")]
        ids = np.full(len(f), -1)
        ids[frequent] = np.arange(len(frequent)) * buckets + bucket
        named = one[frequent]
        names = pa.array(list(numbers), pa.string()).take(pa.array(lang[named]))
        vocabulary = [ids[frequent], names, coded.take(pa.array(named)).dictionary_decode(), f[frequent]]
        told = []
        for shard, steps, a, b in zip(rows["shard"].to_pylist(), rows["i"].to_pylist(), [0, *ends], ends):
            own = ids[of[a:b]]
            if (own >= 0).any():
                told.append((shard, _numbers(_steps(np.cumsum(_read_numbers(steps))[own >= 0])), _numbers(own[own >= 0])))
        return _either(FREQUENT_WORDS, [pa.int64(), pa.binary(), pa.binary()], told, [pa.int64(), pa.string(), pa.string(), pa.int64()], vocabulary)

    return run


def _either(schema: str, left: list[pa.DataType], told: list[tuple], right: list[pa.DataType], columns: list) -> pa.Table:
    """Rows with the left columns only, then rows with the right ones only."""
    first = [pa.array(c, t) for c, t in zip(zip(*told), left)] if told else [pa.nulls(0, t) for t in left]
    second = [pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(columns, right)]
    parts = [[*first, *(pa.nulls(len(told), t) for t in right)], [*(pa.nulls(len(second[0]), t) for t in left), *second]]
    return pa.concat_tables([pa.Table.from_arrays(p, _names(schema)) for p in parts])


def _read_items(raw: bytes, length: int) -> np.ndarray:
    """Words of phrases packed by _sent, a row for each place."""
    items = _read_numbers(raw).reshape(length, -1)
    np.cumsum(items[0], out=items[0])
    return items


def _phrase_items(phrases: np.ndarray) -> bytes:
    """Sorted phrases, a row for each place, packed."""
    return _numbers(np.concatenate([_steps(phrases[0]), *phrases[1:]]))


def _key(phrases: np.ndarray) -> np.ndarray:
    """A number for each phrase, in the order of phrases."""
    key = phrases[0]
    for c in phrases[1:]:
        values = int(c.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * values >= 1 << 62:
            (key, c), values = (np.unique(x, return_inverse=True)[1] for x in (key, c)), len(c)
        key = key * values + c
    return key


def _sent(shard: int, found: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Phrases (rows of numbers) and counts of a shard as rows of PHRASES."""
    for length in sorted({p.shape[1] for p, _ in found}):
        phrases = np.concatenate([p for p, _ in found if p.shape[1] == length]).T
        counts = np.concatenate([n for p, n in found if p.shape[1] == length])
        order = np.argsort(_key(phrases))
        phrases, counts = phrases[:, order], counts[order]
        mixed = np.zeros(len(counts), np.uint64)
        for c in phrases:
            mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        rows = [(h, length, shard, _phrase_items(phrases[:, at]), _numbers(counts[at])) for h, at in _dealt(bucket)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _names(PHRASES))


def _add_phrases(least: int, tell: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Rows of PHRASES of a bucket to rows of FREQUENT; without `tell`, shards are told nothing."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        length = key[1].as_py()
        phrases = [_read_items(x, length) for x in rows["items"].to_pylist()]
        ends = np.cumsum([p.shape[1] for p in phrases])
        phrases = np.concatenate(phrases, axis=1)
        one, f, of = _sums(_key(phrases), np.concatenate([_read_numbers(x) for x in rows["counts"].to_pylist()]))
        frequent = f >= least
        told = []
        for shard, a, b in zip(rows["shard"].to_pylist(), [0, *ends], ends) if tell else ():
            own = frequent[of[a:b]]
            if own.any():
                told.append((shard, _phrase_items(phrases[:, a:b][:, own])))
        named = phrases[:, one[frequent]].T
        ids = pa.ListArray.from_arrays(pa.array(np.arange(len(named) + 1) * length, pa.int32()), pa.array(named.ravel()))
        return _either(FREQUENT, [pa.int64(), pa.binary()], told, [pa.list_(pa.int64()), pa.int64()], [ids, f[frequent]])

    return run


def _shards_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Place in the batch, shard, its text as numbers (-1 between pieces), and its frequent words, ascending: numbers here and over all shards."""
    for k in range(batch.num_rows):
        shard, codes, one = (c[k].as_py() for c in batch.columns[:3])
        here = np.concatenate([np.cumsum(_read_numbers(x["i"])) for x in one])
        ids = np.concatenate([_read_numbers(x["ids"]) for x in one])
        order = np.argsort(here)
        yield k, shard, _read_numbers(codes) - 1, here[order], ids[order]


def _sending(shard: int, grown: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """What a shard sends, SENT phrases at a time."""
    found, n = [], 0
    for phrases, counts in grown:
        found.append((phrases, counts))
        n += len(counts)
        if n >= SENT:
            yield from _sent(shard, found, buckets)
            found, n = [], 0
    yield from _sent(shard, found, buckets)


def _pairs(told: DataFrame, buckets: int) -> DataFrame:
    """The pairs of frequent words of all shards as rows of PHRASES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, shard, line, here, ids in _shards_of(b):
                maps = Bitmaps(line, here)
                grown = ((ids[p], n) for some in maps.batches() for p, n in maps.grow(*some, 2, None))
                yield from _sending(shard, grown, buckets)

    return told.select("shard", "codes", "one").mapInArrow(run, PHRASES)


def _longer(told: DataFrame, longest: int, buckets: int) -> DataFrame:
    """The phrases of three words or more of all shards, all of whose pairs are frequent, as rows of PHRASES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, shard, line, here, ids in _shards_of(b):
                order = np.argsort(ids)
                pairs = np.concatenate([_read_items(x, 2) for x in b.column(3)[k].as_py()], axis=1)
                # places, among the frequent words, of both words of the pairs
                x, y = (order[np.searchsorted(ids[order], c)] for c in pairs)
                usable = np.unique(np.concatenate([x, y]))
                maps = Bitmaps(line, here[usable])
                own = ids[usable]
                allowed = np.unique(np.searchsorted(usable, x) * len(usable) + np.searchsorted(usable, y))
                grown = ((own[p], n) for some in maps.batches() for p, n in maps.grow(*some, longest, allowed, 3))
                yield from _sending(shard, grown, buckets)

    return told.select("shard", "codes", "one", "two").mapInArrow(run, PHRASES)


def _bucketwise(rows: DataFrame, keys: list[str], add: Callable[[tuple, pa.Table], pa.Table], schema: str, name: str) -> DataFrame:
    """The rows of each bucket through `add`, written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartition(parts, "bucket").groupBy(*keys).applyInArrow(add, schema), name)


def frequent_phrases(table: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, len, f of all words and phrases that occur at least `least` times."""
    tokens = table.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).agg(F.sum("n")).first()[0] or 0
    # two for each partition at least, so that all have some
    buckets = parts_for(tokens, BUCKET_TOKENS, 2 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = _bucketwise(_words(table, buckets), ["bucket"], _add_words(least, buckets), FREQUENT_WORDS, "frequent-words")
    vocabulary = one.filter("shard is null").select("id", "lang", "phrase", "f")
    counted = []
    if longest > 1:
        # shards without a frequent word have nothing to build on
        own = one.filter("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("i", "ids")).alias("one"))
        told = table.select("shard", "codes").join(own, "shard")
        two = _bucketwise(_pairs(told, buckets), ["bucket", "len"], _add_phrases(least, longest > 2), FREQUENT, "frequent-pairs")
        counted.append(two.filter("shard is null").select("ids", "f"))
    if longest > 2:
        own = two.filter("shard is not null").groupBy("shard").agg(F.collect_list("items").alias("two"))
        more = _longer(told.join(own, "shard"), longest, buckets)
        more = _bucketwise(more, ["bucket", "len"], _add_phrases(least, False), FREQUENT, "frequent-longer")
        counted.append(more.select("ids", "f"))
    parts = [vocabulary.select("lang", "phrase", F.lit(1).alias("len"), "f")]
    if counted:
        several = reduce(DataFrame.unionByName, counted)
        each = several.select("ids", "f", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "lang", "phrase"), "id")
        words = F.sort_array(F.collect_list(F.struct("at", "phrase"))).alias("words")
        named = each.groupBy("ids").agg(F.first("lang").alias("lang"), words, F.first("f").alias("f"))
        parts.append(named.select("lang", F.array_join("words.phrase", " ").alias("phrase"), F.size("ids").alias("len"), "f"))
    return cut(reduce(DataFrame.unionByName, parts), "phrases")


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, len, a, l, r, score of the phrases of two words or more, at their lowest-scoring cut."""
    f = phrases.select(F.col("lang").alias("f_lang"), F.col("phrase").alias("f_phrase"), "f")
    several = phrases.filter(F.col("len") > 1).select("lang", "phrase", "len", F.col("f").alias("a"))
    k = F.col("k")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cuts = cuts.select("*", _part(F.lit(1), k).alias("left"), _part(k + 1, F.col("len") - k).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        on = (F.col("lang") == F.col("f_lang")) & (F.col(side) == F.col("f_phrase"))
        cuts = cuts.join(f.withColumnRenamed("f", name), on).drop("f_lang", "f_phrase")
    value = F.expr("2000000BD * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", value).groupBy("lang", "phrase", "len", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "len", "a", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, rows: DataFrame, longest: int = LONGEST, covered: int = COVERED) -> DataFrame:
    """The rows whose phrase isn't inside a longer one that has `covered` percent of its count."""
    longer = phrases.filter(F.col("len") > 2).select("lang", "phrase", "len", "f")
    at = F.explode(F.sequence(F.lit(1), F.col("len") - F.col("size") + 1))
    inner = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("len") - 1))).withColumn("at", at)
    inner = inner.select(F.col("lang").alias("i_lang"), _part(F.col("at"), F.col("size")).alias("i_phrase"), "f")
    most = inner.groupBy("i_lang", "i_phrase").agg(F.max("f").alias("most"))
    joined = rows.join(most, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")), "left")
    stands = _exact("most") * F.lit(100) >= _exact("a") * F.lit(covered)
    return joined.filter(~F.coalesce(stands, F.lit(False))).drop("i_lang", "i_phrase", "most")


def best_of(rows: DataFrame, top: int = TOP, group: int = GROUP) -> DataFrame:
    """The first `top` of each language with their rank, by rounds over groups of bounded size."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = cut(rows, "scored")
    group = max(group, 2 * top)
    while True:
        most = rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
        if most <= group:
            break
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("phrase", F.lit(most)), F.lit(-(-most // group))))
        ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order)))
        rows = cut(ranked.filter(F.col("rank") <= top).drop("rank", "deal"), "best")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    table = shards(docs, shard_bytes)
    sizes = table.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))
    phrases = frequent_phrases(table, least, longest)
    best = best_of(uncovered(phrases, scored(phrases), longest), top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT doc_id, lang, row_number() OVER () AS piece, p FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
g AS (
  SELECT lang, w[i:i + n - 1] AS g, n FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)
), f AS (SELECT lang, g, n AS len, count(*) AS f FROM g GROUP BY lang, g, n HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM (SELECT lang, g, len, f, unnest(range(1, len)) AS k FROM f WHERE len > 1) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1:c.len]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g[i:i + n - 1] AS g, max(f) AS most FROM (
    SELECT lang, g, f, n, unnest(range(1, len - n + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS n) WHERE len > n)
  GROUP BY ALL
), named AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.g = i.g
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM named) JOIN total USING (lang)
WHERE rank <= 2000
"""
