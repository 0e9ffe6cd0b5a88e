"""Filter audit, line labelling and phrase mining against brute force, with nulls, ties, repeated rows and empty tables."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from karst.llm import op11_audit, op12_lines, op13_phrases

WORDS = "the of and cat dog sun moon runs sleeps blue green seven river".split()
SCHEMA = "doc_id long, text string, lang string, source string, n string, key string, mask string, shard string, kept string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)

    def prose(n):
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))

    out = [(i, prose(rng.choice([3, 40, 260])), rng.choice(["en", "de", None])) for i in range(60)]
    out += [(100, out[3][1], "de"), (101, out[3][1], None), (2, out[7][1], "en"), out[5], out[5], (None, out[5][1], "en"), (None, prose(9), "de")]
    out += [(200, None, "en"), (201, "", None), (202, " \t\n\x0b ", "fr"), (203, "A|B " * 300, "en"), (204, "É漢 字ÀB. " * 50, "de")]
    out += [(205, "x" * 30_000, "en"), (206, "The Cat! the cat? THE CAT; " * 400, "en"), (207, "a\n" * 2_000, "fr")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * 6) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    some = [(i, i % 2, i % 3 == 0) for i in range(0, 210, 2)] + [(4, 1, 0), (4, None, None), (None, 1, 1)]
    return spark.createDataFrame([(a, b, None if c is None else int(c), 5) for a, b, c in some], "doc_id long, quality int, toxic int, good int")


# --- 11 ----------------------------------------------------------------------------------------


def test_plain_changes_visit_all_orders():
    for k in range(1, 7):
        order, seen = list(range(k)), [tuple(range(k))]
        for i in op11_audit.plain_changes(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(k)))


def brute_steps(failed, names):
    """failed: a set of names for each document, with its good and toxic flags."""
    out = {}
    for order in itertools.permutations(names):
        left = list(failed)
        for step, f in enumerate(order, 1):
            gone = [d for d in left if f in d[0]]
            left = [d for d in left if f not in d[0]]
            every = [d for d in failed if f in d[0]]
            alone = sum(d[0] == {f} for d in failed)
            out["".join(order), step] = (len(left), len(gone), len(every) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone))
    share = Counter()
    for (order, step), v in out.items():
        share[order[step - 1]] += v[1]
    return {(*k, *v, share[k[0][k[1] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("names", ["A", "XY", "ABC", "pqrs"])
def test_walk(names):
    rng = random.Random(len(names))
    failed = [({n for n in names if rng.random() < 0.4}, rng.random() < 0.5, rng.random() < 0.2) for _ in range(80)]
    cells = np.zeros((3, 1 << len(names)), np.int64)
    for f, good, toxic in failed:
        cells[:, sum(1 << names.index(n) for n in f)] += (1, good, toxic)
    got = list(op11_audit.Walk(names, *cells).rows())
    assert len(got) == len(set(got)) and set(got) == brute_steps(failed, names)


def test_audit(docs, labels, rows):
    told = {}
    for r in labels.collect():
        good, toxic = told.get(r["doc_id"], (False, False))
        told[r["doc_id"]] = (good or r["quality"] == 1, toxic or r["toxic"] == 1)
    parts = {}
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = doc_id is not None and any((x[1] or "") == t and x[0] is not None and x[0] < doc_id for x in rows)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": smaller,
        }
        flags = told.get(doc_id, (False, False)) if doc_id is not None else (False, False)
        parts.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, *flags))
    got = op11_audit.audit(op11_audit.masks(docs, labels), "ABCDE").collect()
    assert len(got) == 600 * len(parts)
    for part, failed in parts.items():
        assert {tuple(r)[1:] for r in got if r["part"] == part} == brute_steps(failed, "ABCDE")


def test_audit_empty(docs, labels):
    assert op11_audit.audit(op11_audit.masks(docs.limit(0), labels), "ABCDE").count() == 0
    assert op11_audit.audit(op11_audit.masks(docs, labels.limit(0)), "ABCDE").agg({"good_lost": "sum"}).first()[0] == 0
    with pytest.raises(ValueError):
        op11_audit.audit(docs, "ABCDEFGHI")


# --- 12 ----------------------------------------------------------------------------------------


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = t.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 3000 else 1999
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", t))
    return (len(w), sum(map(len, w)), symbols, dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))


def test_rules(docs, rows, labels):
    got = op12_lines.judge(docs, op12_lines.fit(docs, labels)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in got)
    assert own == sorted((str(r[0]), *brute_rules(r[1])) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_repeated_windows():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 16, 40, 200):
        w = [rng.choice([b"a", b"b"]) for _ in range(n)]
        assert int(op12_lines.repeated(op12_lines.numbered(w)).sum()) == brute_rules(" ".join(x.decode() for x in w))[4]


def random_field(rng):
    return op12_lines.Field(rng.normal(size=op12_lines.FEATURES * op12_lines.BINS), 0.3, rng.normal(size=(2, 2)))


def chain_score(field, bins, labels):
    u = field.scores(bins)
    total = labels[0] * field.start + sum(u[t] for t in range(len(labels)) if labels[t])
    return total + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:]))


def test_decode_and_likelihood_against_all_labellings():
    rng = np.random.default_rng(3)
    field = random_field(rng)
    chains = [rng.integers(0, op12_lines.BINS, (n, op12_lines.FEATURES)).astype(np.uint8) for n in (7, 4, 4, 1)]
    labels = np.zeros((4, 7), np.int64)
    expected = 0.0
    for row, bins in enumerate(chains):
        every = list(itertools.product((0, 1), repeat=len(bins)))
        scores = [chain_score(field, bins, x) for x in every]
        assert chain_score(field, bins, field.decode(bins).tolist()) == pytest.approx(max(scores))
        labels[row, : len(bins)] = every[rng.integers(len(every))]
        expected += chain_score(field, bins, labels[row, : len(bins)].tolist()) - np.logaddexp.reduce(scores)
    lengths, flat = np.array([7, 4, 4, 1]), np.concatenate(chains)
    value, w, s, p = op12_lines.likelihood(field, flat, lengths, labels)
    assert value == pytest.approx(expected)
    for i in (0, 9, 40, 77):
        moved = op12_lines.Field(field.weights + 1e-6 * np.eye(1, len(field.weights), i)[0], field.start, field.pairs)
        assert (op12_lines.likelihood(moved, flat, lengths, labels)[0] - value) / 1e-6 == pytest.approx(w[i], abs=1e-4)
    moved = op12_lines.Field(field.weights, field.start + 1e-6, field.pairs)
    assert (op12_lines.likelihood(moved, flat, lengths, labels)[0] - value) / 1e-6 == pytest.approx(s, abs=1e-4)
    for i, j in itertools.product((0, 1), repeat=2):
        shift = np.zeros((2, 2))
        shift[i, j] = 1e-6
        moved = op12_lines.Field(field.weights, field.start, field.pairs + shift)
        assert (op12_lines.likelihood(moved, flat, lengths, labels)[0] - value) / 1e-6 == pytest.approx(p[i, j], abs=1e-4)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = op12_lines.fit(docs, labels)
    got = op12_lines.judge(docs, field).join(labels, "doc_id").filter(op12_lines.id_mod("doc_id", 5) == 0).filter("not base_failed").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.75 * len(bad)


def test_marked_lines():
    rng = random.Random(2)
    clean = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 16))).capitalize() + ".\n" for _ in range(60)]
    menu = [" | ".join(rng.choice(WORDS) for _ in range(12)) + "\n" for _ in range(60)]
    texts = ["".join(rng.sample(clean, 5)) for _ in range(30)] + ["".join(rng.sample(clean, 1) + rng.sample(menu, 6)) for _ in range(30)]
    field = op12_lines.fit_chains([op12_lines.read(t.encode()).bins for t in texts], np.array([True] * 30 + [False] * 30))
    assert [m for _, m in op12_lines.marked_lines(clean[0] + menu[0] + menu[1] + "\n" + menu[2], field)] == [True, False, False, False]
    assert op12_lines.marked_lines(None, field) == []


def test_lines_without_labels(docs, labels):
    field = op12_lines.fit(docs, labels.limit(0))
    got = op12_lines.judge(docs, field)
    assert all(r["kept"] != r["base_failed"] for r in got.collect())
    assert op12_lines.judge(docs.limit(0), field).count() == 0
    assert not op12_lines.fit(docs.limit(0), labels).weights.any()


# --- 13 ----------------------------------------------------------------------------------------


def brute_phrases(rows, least, longest, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        longer = [c for (g, *x), c in f.items() if g == lang and len(x) > len(w) and c >= least and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if any(100 * c >= 80 * a for c in longer):
            continue
        cuts = [(f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    ranked, at = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(ranked)


@pytest.mark.parametrize("least,longest,top,size", [(30, 4, 2000, 8 << 20), (3, 4, 2000, 2_000), (2, 3, 5, 500), (2, 5, 40, 10_000), (2, 2, 7, 1)])
def test_phrases(docs, rows, monkeypatch, least, longest, top, size):
    monkeypatch.setattr(op13_phrases, "GROUP", 20)
    if size < 5_000:
        monkeypatch.setattr(op13_phrases, "BATCH", 7)
    got = op13_phrases.mine(docs, least, longest, top, size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, longest, top)


def test_best_of_goes_in_rounds(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"p{i}", rng.randint(1, 9), rng.randint(1, 50)) for i in range(3000)]
    got = op13_phrases.best_of(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 30, 100).collect()
    for lang in "ab":
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1].encode()))[:30]
        assert [r["phrase"] for r in sorted(got, key=lambda r: r["rank"]) if r["lang"] == lang] == [r[1] for r in own]


def test_products_beyond_64_bits(spark):
    big = 1 << 60
    phrases = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big + 7), ("x", "a b", 2, big - 5)], "lang string, phrase string, len int, f long")
    got = op13_phrases.scored(phrases).first()
    assert got["score"] == 2_000_000 * (big - 5) // (2 * big + 7)


def test_phrases_empty(docs):
    assert op13_phrases.mine(docs.limit(0)).count() == 0
    assert op13_phrases.mine(docs.filter("doc_id = 200")).count() == 0


def shuffled(spark, after=-1):
    """(last stage, bytes that the stages after `after` wrote for others)."""
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    found = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())]
    return max((i for i, _ in found), default=-1), sum(n for i, n in found if i > after)


def test_phrases_move_less_than_the_text(spark):
    """Most pairs are rare in each shard: a row for each would be several times the text."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(400)) for _ in range(600)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(4).cache()
    docs.count()
    last, _ = shuffled(spark)
    table = op13_phrases.shards(docs, 100_000)
    assert table.count() >= 8
    op13_phrases.frequent_phrases(table).count()
    assert shuffled(spark, last)[1] < sum(map(len, texts))


def test_numbers_come_back():
    for a in ([], [0, 0], [255, 256, 0], [1 << 62, 1], list(range(70_000))):
        got = op13_phrases._read_numbers(op13_phrases._numbers(np.array(a, np.int64)))
        assert got.dtype == np.int64 and got.tolist() == a


@pytest.mark.parametrize("wide", [1, 1 << 31, 1 << 40, 1 << 61])
def test_keys_follow_phrases(wide):
    rng = np.random.default_rng(1)
    phrases = rng.integers(0, 3, (4, 300)) * wide
    key = op13_phrases._key(phrases).tolist()
    rows = list(map(tuple, phrases.T.tolist()))
    assert [rows[i] for i in np.argsort(key, kind="stable")] == sorted(rows)
    assert len(set(zip(key, rows))) == len(set(key)) == len(set(rows))


@pytest.mark.parametrize("sent", [1, 50, 1 << 20])
def test_buckets_add_up_what_shards_sent(monkeypatch, sent):
    monkeypatch.setattr(op13_phrases, "SENT", sent)
    rng = np.random.default_rng(2)
    f, own, rows = Counter(), {}, {}
    for shard in (0, 7, 1 << 40):
        grown = []
        for first in range(6):
            for length in (3, 4):
                p = np.unique(np.column_stack([np.full(20, first), rng.integers(0, 3, (20, length - 1))]), axis=0) * 1000
                n = rng.integers(1, 9, len(p))
                grown.append((p, n))
                f.update({tuple(x): int(k) for x, k in zip(p.tolist(), n)})
                own.setdefault(shard, set()).update(map(tuple, p.tolist()))
        for b in op13_phrases._sending(shard, iter(grown), 5):
            for r in b.to_pylist():
                rows.setdefault((r["bucket"], r["len"]), []).append(r)
    counted, told = {}, {}
    for (bucket, length), some in rows.items():
        out = op13_phrases._add_phrases(10, True)((pa.scalar(bucket), pa.scalar(length)), pa.Table.from_pylist(some)).to_pylist()
        for r in out:
            if r["shard"] is None:
                assert tuple(r["ids"]) not in counted
                counted[tuple(r["ids"])] = r["f"]
            else:
                told.setdefault(r["shard"], []).extend(map(tuple, op13_phrases._read_items(r["items"], length).T.tolist()))
    assert counted == {p: n for p, n in f.items() if n >= 10}
    assert {s: sorted(set(x)) for s, x in told.items()} == {s: sorted(p for p in x if f[p] >= 10) for s, x in own.items()}
