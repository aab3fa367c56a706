"""Classifiers, language model, language identification: held-out accuracy and brute force."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest

from plumbline.llm import compression, language, language_model, quality, queries, toxicity
from plumbline.llm.elias_fano import EliasFano, encode

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1), (5, 7), (1000, 1 << 20), (5000, 1 << 58), (300, 300), (3000, 1 << 63)])
@pytest.mark.parametrize("crowded", [False, True])
def test_elias_fano(n, universe, crowded):
    rng = np.random.default_rng(n)
    v = rng.integers(0, universe, n).astype(np.uint64)
    if crowded and universe > 1 << 19:
        v[: n // 2] = np.arange(n // 2) * 3
    v = np.sort(v)
    e = EliasFano(encode(v, universe))
    assert (e.access(np.arange(n)) == v).all()
    q = np.concatenate((v, rng.integers(0, universe, 200).astype(np.uint64)))
    have = set(v.tolist())
    for x, i in zip(q.tolist(), e.find(q), strict=True):
        assert v[i] == x if x in have else i < 0


def test_language_model_against_dictionaries(spark, docs):
    got = queries.op2_language_model(spark, SF).toPandas().set_index("doc_id")
    rows = docs.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    train = [tokens(r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c1 = collections.Counter(w for t in train for w in t)
    c2 = collections.Counter(x for t in train for x in zip(t, t[1:], strict=False))
    c3 = collections.Counter(x for t in train for x in zip(t, t[1:], t[2:], strict=False))
    n, v, d = sum(c1.values()), len(c1), language_model.DISCOUNT
    k2, k3 = c2, c3
    left1, left2 = collections.defaultdict(float), collections.defaultdict(float)
    for (a, _), c in k2.items():
        left1[a] += (c - d) / c1[a]
    for (a, b, _), c in k3.items():
        left2[a, b] += (c - d) / c2[a, b]
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)
    p2 = lambda a, w: max(k2.get((a, w), d) - d, 0) / max(c1[a], 1) + (1 - left1.get(a, 0)) * p1(w)
    p3 = lambda a, b, w: max(k3.get((a, b, w), d) - d, 0) / max(c2[a, b], 1) + (1 - left2.get((a, b), 0)) * p2(b, w)
    for r in rows:
        t, x = tokens(r.text), got.loc[r.doc_id]
        base = sum(math.log10(p1(w)) for w in t)
        score = sum(math.log10(p1(w) if i == 0 else p2(t[0], w) if i == 1 else p3(t[i - 2], t[i - 1], w)) for i, w in enumerate(t))
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(c1[w] > 0 for w in t), n)
        assert abs(base - x.base_score) < 1e-6 * abs(base)
        assert abs(score - x.score) < 0.05 * len(t)  # quantised
    held = got[got.held_out]
    assert held.score.sum() > 0.97 * held.base_score.sum()


def test_language_model_odd_inputs(spark):
    e = spark.createDataFrame([(1, None), (2, ""), (None, "a b a b"), (2, "a b a b")], "doc_id long, text string")
    r = language_model.scored(e, language_model.build(e)).toPandas()
    assert len(r) == 4 and (r["train_tokens"] == 12 - (1 if zlib.crc32(b"1") % 7 == 2 else 0) - 6 * (zlib.crc32(b"2") % 7 == 2)).all()
    none = language_model.scored(e, language_model.build(e.limit(0))).toPandas()
    assert (none["score"] == 0).all() and (none["n_known"] == 0).all()
    assert language_model.scored(e.limit(0), language_model.build(e)).count() == 0


def test_pairs_and_triples_seen_once_count(spark):
    """A text whose pairs and triples stand once in the training texts scores above one of the same words in another order."""
    d = spark.createDataFrame([(1, "red green blue grey pink teal")], "doc_id long, text string")
    e = spark.createDataFrame([(1, "red green blue grey pink teal"), (2, "teal pink grey blue green red")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in language_model.scored(e, language_model.build(d, modulus=1, held=5)).collect()}
    assert r[1]["base_score"] == pytest.approx(r[2]["base_score"]) and r[1]["score"] > r[2]["score"] + 1


def test_level_files_hold_whole_distributions(spark, docs):
    """Over all words the probabilities after a context add up to one, up to quantisation."""
    info = language_model.build(docs.limit(300))
    trie = language_model.Trie(info)
    v = int(info["words"][-1])
    total = np.array([v + trie.n])  # (c + 1) over all words
    assert total[0] == v + trie.n
    words = np.arange(v)
    counts = trie.counts(words)
    u = int(np.argmax(counts))
    pairs = trie.children("pairs", np.full(v, u), words)
    weight = 10 ** trie.value("pairs", "weight", np.array([u]))[0]
    p = weight * (counts + 1) / (trie.n + trie.v + 1)
    hit = pairs >= 0
    p[hit] = 10 ** trie.value("pairs", "prob", pairs[hit])
    assert abs(p.sum() + weight / (trie.n + trie.v + 1) - 1) < 0.02


@pytest.mark.parametrize("name,label,least", [("op1_quality", "quality", 0.96), ("op10_toxicity", "toxic", 0.95)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    where = "/root/testdata/sf0.1"
    got = queries.queries()[name](spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held["predicted"] == held[label]).mean() >= least
    assert got["score"].between(0, 1).all()


def test_classifiers_do_not_need_labels(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "idiot", "x")], "doc_id long, text string, __other string")
    for labels in ([], [(1, 1, 0)], [(9, None, None)]):
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for fit in (quality.fit, toxicity.fit):
            r = compression.scored(d, fit(d, lab)).collect()
            assert len(r) == 3 and all(0 <= x["score"] <= 1 for x in r)
        assert toxicity.clean(d.limit(0), lab).count() == 0
        kept = toxicity.clean(d, lab)  # without both classes nothing can be told apart, so nothing goes
        assert kept.columns == d.columns and kept.count() == 3


def test_one_class_alone_drops_nothing(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for some in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("toxic = 0")):
        assert toxicity.clean(docs, some).count() == docs.count()


def test_samples_are_bounded_and_whole(spark):
    """Ids that repeat with many texts, equal rows and long texts: so many rows of each class, each text as it is."""
    d = spark.createDataFrame([(1, f"t{i} " + "x" * 40_000) for i in range(300)] + [(2, "same")] * 300 + [(k, f"u{k}") for k in range(3, 90)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2, k % 2) for k in range(90)] * 2, "doc_id long, quality int, toxic int")
    rows = compression.sample(d, lab, "toxic", 5, 0, per_class=20).collect()
    assert max(sum(r["_y"] == c for r in rows) for c in (0, 1)) == 20
    texts = {r.text.encode() for r in d.collect()}
    assert all(bytes(r["_t"]) in texts for r in rows) and len({(r["_id"], bytes(r["_t"])) for r in rows}) == len(rows)
    again = compression.sample(d.repartition(7), lab, "toxic", 5, 0, per_class=20).collect()
    assert sorted((r["_id"], bytes(r["_t"])) for r in again) == sorted((r["_id"], bytes(r["_t"])) for r in rows)


def test_windows_keep_the_least_hashes():
    import xxhash

    parts = [f"w{i % 700}".encode() for i in range(3000)]
    w = compression.Windows(50)
    w.add(parts)
    assert w.content(10_000) == b"".join(sorted(set(parts), key=xxhash.xxh3_64_intdigest)[:50])


def test_whole_texts_are_scored(spark, docs):
    """A toxic passage at the very end of a very long text counts."""
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = next(r.text for r in docs.collect() if r.lang == "en" and len(r.text) > 3000 and model.score([r.text.encode()])[0] < 0.05).encode()
    long = b" ".join([clean] * 60)
    a, b = model.score([long, long + b" you idiot loser scum moron clown stupid trash worthless pathetic disgusting idiot loser scum moron"])
    assert b > a and b > 0.5


def test_languages(spark, docs):
    got = queries.op8_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_mixtures(spark, docs):
    rows = docs.collect()
    de, en = (next(r.text for r in rows if r.lang == x and 2000 < len(r.text) < 6000) for x in ("de", "en"))
    cut = min(len(de), len(en))
    d = spark.createDataFrame([(1, de[:cut] + " " + en[:cut]), (2, en)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identified(d, language.fit(docs)).collect()}
    assert {x["lang"] for x in got[1]["languages"]} == {"de", "en"} and got[1]["score"] < 0.7
    assert [x["lang"] for x in got[2]["languages"]] == ["en"]


def test_a_language_s_sample_is_bounded(spark):
    """A language with most rows is learnt from about as many as the others; equal rows once."""
    d = spark.createDataFrame([(i, f"alpha{i} beta", "aa") for i in range(20_000)] + [(i, "gamma delta", "bb") for i in [5] * 5000], "doc_id long, text string, lang string")
    names, counts = language.sample_counts(d, 4, 9, per_language=200)
    whole = {"aa": 10 + 4 + 4, "bb": 5 + 5}
    assert names == ["aa", "bb"] and 100 * 9 < counts[0].sum() < 300 * whole["aa"] and counts[1].sum() in (0, whole["bb"])


def test_languages_odd_inputs(spark):
    e = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (None, "12 34!", "fr"), (4, "the thing is that", "en"), (5, "é", None), (5, "é", None)], "doc_id long, text string, lang string")
    r = language.identified(e, language.fit(e, 4, 9)).orderBy("doc_id").collect()
    assert [x["lang_pred"] for x in r] == ["und", "und", "und", "en", "en", "en"]
    assert {x["lang_pred"] for x in language.identified(e, language.fit(e.limit(0))).collect()} == {"und"}
    assert language.identified(e.limit(0), language.fit(e)).count() == 0
