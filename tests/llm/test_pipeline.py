"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest

import corpus_pipeline
from karst.llm import common, op2_toxicity, op5_minhash
from tests.llm.test_small import brute_hits, brute_near, lower

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for name, f in corpus_pipeline.STAGES:
        docs = common.cut(f(spark, docs, DATA), name)
        seen.append(docs)
    return seen


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_toxicity_stage(spark, stages):
    model = op2_toxicity.fit(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = ids(op2_toxicity.score(stages[0], model).filter("predicted = 0"))
    assert ids(stages[1]) == kept


def test_exact_stage(stages):
    best = {}
    for i, t in rows(stages[1]):
        best[lower(t)] = max(i, best.get(lower(t), i))
    assert ids(stages[2]) == sorted(best.values())


def test_near_stage(stages):
    assert ids(stages[3]) == sorted(int(a) for a, b, _ in brute_near(rows(stages[2])) if a == b)


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {}
    for i, t in items:
        w = re.findall(common.WORD_CLASS, lower(t))
        for a in range(max(1, len(w) - 9)):
            windows.setdefault(" ".join(w[a : a + 10]), i)
    clean = []
    for i, t in rows(stages[3]):
        w = " " + " ".join(re.findall(common.WORD_CLASS, lower(t))) + " "
        if not any(f" {x} " in w for x in windows):
            clean.append(i)
    assert ids(stages[4]) == sorted(clean)


def test_last_stage_and_run(spark, stages):
    assert ids(stages[5]) == ids(stages[4])
    assert stages[5].filter("not round_trip").count() == 0
    assert ids(corpus_pipeline.run(spark, DATA)) == ids(stages[5])


def test_repeated_rows_and_nulls(spark):
    data = [(1, "same words here", "en", "s", 1)] * 2 + [(2, None, "en", "s", 1), (None, "other words", None, None, None), (3, "SAME words here", "en", "s", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.exact_dedup(spark, docs, DATA)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["2", "3", "None"]
    again = corpus_pipeline.exact_dedup(spark, docs.filter("doc_id = 1"), DATA)
    assert again.count() == 1
    for stage in corpus_pipeline.STAGES:
        assert stage[1](spark, docs.limit(0), DATA).count() == 0


def test_used_helpers():
    assert brute_hits([(1, "a b")], [(2, "a b")]) == [("1", 2, 2, "2")] and op5_minhash.THRESHOLD == 0.8
