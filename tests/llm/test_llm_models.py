"""Learned operators by held-out accuracy, search by recall, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import crf, projection_index, queries, simhash, toxicity
from lexweave.llm.shared import Scratch

MORE = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    out = queries.op6_language(spark, MORE).join(spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98 and all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the and of", "en"), (2, "der die das", "de"), (3, "the or is", "en"), (4, "und der ist", "de"), (5, None, "en"), (6, "12 ..", None), (None, "the", "en")], "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    model = crf.fit(docs.where("doc_id < 5"))
    out = {r["doc_id"]: r for r in crf.identify(docs, model).collect()}
    assert out[5]["lang_pred"] == "und" and out[6]["lang_pred"] == "und" and out[5]["score"] == 0.0
    assert out[1]["lang_pred"] == "en" and out[4]["lang_pred"] == "de"
    none = crf.fit(docs.where("false"))
    assert {r["lang_pred"] for r in crf.identify(docs, none).collect()} == {"und"}
    assert crf.identify(docs.where("false"), model).count() == 0


def test_blocked_marginals_are_exact():
    rng = np.random.default_rng(2)
    model = crf.Crf(["a", "b", "c"], np.zeros((crf.SLOTS, 3)), rng.normal(size=(3, 3)))
    sizes = np.array([1, 31, 32, 33, 200, 5])
    scores = rng.normal(size=(sizes.sum(), 3)) * 3
    got, begin = model.marginals(scores, sizes)
    a = np.exp(model.moves)
    for b, n in zip(begin, sizes, strict=True):
        e = np.exp(scores[b : b + n])
        f, g = np.zeros((n, 3)), np.zeros((n, 3))
        v = np.full(3, 1 / 3)
        for t in range(n):
            v = (v @ a) * e[t]
            v /= v.sum()
            f[t] = v
        v = np.ones(3)
        for t in range(n - 1, -1, -1):
            g[t] = v
            v = a @ (e[t] * v)
            v /= v.sum()
        p = f * g
        assert np.allclose(p / p.sum(1, keepdims=True), got[b : b + n])


def test_code_switching_is_labelled_by_word(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    model = crf.fit(docs)
    one = {r["lang"]: crf.words_of(r["text"])[:40] for r in docs.where("n_chars > 600").collect()}
    text = one["en"] + one["es"]
    p, _ = model.marginals(model.emissions([text]), np.array([len(text)]))
    names = [model.labels[k] for k in p.argmax(1)]
    want = ["en"] * len(one["en"]) + ["es"] * len(one["es"])
    assert np.mean([x == y for x, y in zip(names, want, strict=True)]) > 0.9


def test_a_long_run_counts_whole():
    run = "日本語" * 50
    assert "".join(crf.words_of(run)) == run and max(map(len, crf.words_of(run))) == crf.LONGEST


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    words = [f"plain{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(words, 40))
        bad = i % 8 == 0
        if bad:
            w[int(rng.integers(40))] = ["vileword", "nastything"][i % 2]
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (10_000, None), (10_001, ""), (None, "vileword")], "doc_id bigint, text string").withColumn("y", F.lit(7))
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (3, None)], "doc_id bigint, toxic int"), Scratch(spark), positives=100, unlabelled=600)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in out.values()) and out[10_000] == out[10_001] < 0.7
    hit = np.mean([out[i] >= 0.7 for i in range(1, 900) if i % 8 == 0])
    wrong = np.mean([out[i] >= 0.7 for i in range(900) if i % 8])
    assert hit > 0.9 and wrong < 0.05
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"), Scratch(spark))
    assert max(r["score"] for r in toxicity.score(docs, none).collect()) < 0.7


def _brute(ids, m, k, q):
    s = (m * m[q]).sum(1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


@pytest.mark.parametrize("kind", ["unit", "lengths", "copies"])
def test_nearest(spark, kind):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(600, 16))
    if kind == "unit":
        m /= np.linalg.norm(m, axis=1, keepdims=True)
    if kind == "copies":
        m[100:400] = m[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [float("inf")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    out = projection_index.nearest(df, df.where("vec_id % 20 = 0"), Scratch(spark)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.arange(600)
    hit = total = 0
    assert set(got) == set(range(0, 600, 20))
    for q in got:
        want = _brute(ids, m, 20, q)
        hit += len({i for i, _ in want} & {i for i, _ in got[q]})
        total += 20
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float((m[i] * m[q]).sum())) < 1e-9 for i, s in got[q])
    assert hit / total >= 0.9


def test_nearest_stops_before_it_has_read_all(spark):
    """20,000 vectors of 16 kinds in several cells and shards, one of them a thousand times; repeated queries."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(16, 48))[np.arange(20_000) % 16] * 0.6 + rng.normal(size=(20_000, 48))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[5000:6000] = m[5000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id % 100 = 0")
    rows = projection_index.nearest(df, asked.union(asked.where("vec_id < 1000")), Scratch(spark)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 20_000, 100)) and all(len(x) == 20 for x in got.values())
    hit = sum(len({i for i, _ in _brute(np.arange(20_000), m, 20, q)} & {i for i, _ in got[q]}) for q in got if not 5000 <= q < 6000)
    assert hit / (20 * (len(got) - 10)) >= 0.9
    assert all(abs(got[q][19][1] - 1) < 1e-9 for q in range(5000, 6000, 100))
    assert np.mean([r["verified"] for r in rows]) < 0.3 * len(m)


def test_nearest_of_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])], "vec_id bigint, embedding array<double>")
    out = projection_index.nearest(df, df.where("vec_id = 0"), Scratch(spark)).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"], r["verified"]) for r in out) == [(1, 1, 2.0, 2), (1, 2, 3.0, 2), (2, 1, 0.0, 2), (2, 2, 0.0, 2)]


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    out = projection_index.nearest(df, df.where("vec_id % 20 = 0"), Scratch(spark)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.5)]
    assert projection_index.nearest(df.where("false"), df, Scratch(spark)).count() == 0


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    cols, kept = docs.columns, docs
    scratch = Scratch(spark)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = scratch.store(stage(spark, kept, data), name)
        sizes.append(kept.count())
        if name != "bpe":
            assert kept.columns == cols
            assert kept.join(docs, "doc_id", "left_anti").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[1] >= 0.98 * sizes[0] and sizes[-1] == sizes[-2]
    assert corpus_pipeline.run(spark, data).count() == sizes[-1]


def test_pipeline_stages_on_odd_rows(spark, data):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "the cat and the dog were here", None, None, None), (3, "the cat and the dog were here", None, None, None), (None, "la casa de las flores", "es", "s", 5)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("fp", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, data)
        assert out.count() <= odd.count() and stage(spark, odd.where("false"), data).count() == 0
        if name != "bpe":
            assert out.columns == odd.columns


def test_bands_are_stable():
    h = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert simhash.band_keys(h) == simhash.band_keys(np.concatenate([h[::-1], h[:5]])) and simhash.band_keys(h[:0]) == []
