"""Nearest neighbours, repetition, mixing, packing and the pipeline."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import mixing, neighbours, packing, queries, repetition

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall(spark, folder):
    where = f"/root/testdata/{folder}"
    e = spark.read.parquet(f"{where}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    got = queries.op5_neighbours(spark, where).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        g = got[got["query_id"] == ids[i]].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and g["score"].is_monotonic_increasing
        at = dict(zip(ids, d, strict=True))
        assert all(abs(at[v] - s) < 1e-12 for v, s in zip(g["vec_id"], g["score"], strict=True))
        hits += len(set(g["vec_id"]) & set(ids[np.lexsort((ids, d))[:10]]))
        total += 10
    assert hits / total >= 0.9


def test_neighbours_odd_inputs(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (100, [2.0, 0.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(e, e.filter("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0)]
    assert neighbours.nearest(e.limit(0), e, k=3).count() == 0


def test_one_vector_of_many_rows(spark):
    """A third of the rows share a vector: its list is their first ids."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 8))
    v[200:400] = v[200]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(e, e.filter("vec_id = 300"), k=10).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(200, 210)) and {r["score"] for r in got} == {0.0}


def repeats_by_brute_force(text: str) -> tuple:
    w = text.encode().split()
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if x.encode().split():
            dup += x in lines
            lines.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_repetition(spark, docs):
    rows = [(-1, None), (-2, ""), (-3, " \n\t"), (None, "é ü\n" * 50), (-4, "a b c d e f g h\n" * 3), (-5, "x" * 300_000 + " y"), (-5, "x" * 300_000 + " y")]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = collections.defaultdict(list)
    for r in d.collect():
        texts[r.doc_id].append(r.text or "")
    got = repetition.repetition(d).collect()
    assert len(got) == d.count()
    for r in got:
        want = repeats_by_brute_force(texts[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.kept or not r.base_failed)


def test_words_of_one_polynomial(spark):
    """A Thue-Morse word and its complement agree under any polynomial modulo 2^64; they are two words and two lines here."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(1, f"{a}\n{b}\n" + " ".join([a, "x"] * 4) + "\n" + " ".join([b, "x"] * 4))], "doc_id long, text string")
    r = repetition.repetition(d).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == repeats_by_brute_force(d.first().text)
    from plumbline.llm import language_model

    e = spark.createDataFrame([(2, a), (3, b)], "doc_id long, text string")
    got = language_model.scored(e, language_model.build(e.filter("doc_id = 2"), modulus=1, held=5)).orderBy("doc_id").collect()
    assert [x["n_known"] for x in got] == [2, 1]


def test_repetition_shares_against_brute_force(spark, docs):
    lengths = sorted(repetition.NGRAM_LIMITS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in repetition.repetition(docs).collect():
        w = texts[r.doc_id].encode().split()
        for n, share in zip(lengths, r.dup_char_shares, strict=True):
            seen, cover = set(), set()
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g in seen:
                    cover.update(range(i, i + n))
                seen.add(g)
            assert abs(share - sum(len(w[i].decode()) for i in cover) / max(1, r.word_chars)) < 1e-12


def test_clean_documents_are_kept(spark):
    where = "/root/testdata/sf0.1"
    d = queries.op6_repetition(spark, where).join(spark.read.parquet(f"{where}/labels.parquet").filter("quality = 1"), "doc_id")
    assert d.filter("not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.99


def test_mixing_query(spark, sf):
    from tests.oracle import assert_same, connect

    assert_same(queries.op7_mixing(spark, sf), connect(sf), queries.OP7_SQL)


def _worst(s, share: dict, only: set | None = None) -> float:
    """The greatest distance from the targets, in blocks, until a source has run out."""
    blocks = s.assign(source=s["source"].fillna("?")).drop_duplicates(["source", "block"])
    assert not blocks["slot"].duplicated().any() and (blocks["slot"] >= blocks["release"]).all() and (blocks["slot"] < blocks["deadline"]).all()
    end = min(b["slot"].max() for _, b in blocks.groupby("source"))
    worst = 0.0
    for k, w in share.items():
        own = np.sort(blocks.loc[blocks["source"] == (k or "?"), "slot"].to_numpy())
        worst = max(worst, *(abs((own < t).sum() - w * t) for t in range(0, int(end) + 1)))
    return worst


MIX = [(i, "a") for i in range(900)] + [(1000 + i, "b") for i in range(500)] + [(2000 + i, None) for i in range(150)] + [(None, "a"), (5, "a"), (5, "a")]


@pytest.mark.parametrize("weights", [{"a": 5.0, "b": 3.0, None: 1.0, "absent": 4.0}, {"a": 0.517, "b": 0.37, None: 0.113}, {"a": 1, "b": 1, None: 1}, {"a": 0.9, "b": 0.0999, None: 0.0001}])
def test_deviation_from_given_weights_is_under_a_block(spark, weights):
    d = spark.createDataFrame(MIX, "doc_id long, source string")
    s = mixing.schedule(d, block=2, weights=weights, frame=100).toPandas()
    assert len(s) == len(MIX)
    total = sum(w for k, w in weights.items() if k != "absent")
    assert _worst(s, {k: w / total for k, w in weights.items() if k != "absent"}) < 1 + 1e-9


def test_deviation_from_counts_is_under_a_block(spark):
    d = spark.createDataFrame(MIX, "doc_id long, source string")
    s = mixing.schedule(d, block=4, frame=100).toPandas()
    w = {k: n**0.5 for k, n in (("a", 903), ("b", 500), (None, 150))}
    slots = {k: int(x * 100 / sum(w.values()) + 0.5) for k, x in w.items()}
    assert len(s) == len(MIX) and _worst(s, {k: n / sum(slots.values()) for k, n in slots.items()}) < 1


def test_a_weight_of_zero_is_out_of_the_mix(spark):
    d = spark.createDataFrame(MIX, "doc_id long, source string")
    s = mixing.schedule(d, block=2, weights={"a": 1.0, "b": 0.0}).toPandas()
    assert len(s) == len(MIX) and (s["slot"].notna() == (s["source"] == "a")).all()
    m = mixing.mixed(d, block=2, weights={"a": 1.0, "b": 0.0})
    assert {r["source"] for r in m.collect()} == {"a"} and m.count() == 903
    assert mixing.mixed(d, weights={}).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(d, weights={"a": -1.0})


def test_a_rare_source_gets_no_more_than_its_weight(spark):
    d = spark.createDataFrame([(i, "a") for i in range(6000)] + [(9000 + i, "b") for i in range(4)], "doc_id long, source string")
    s = mixing.schedule(d, block=1, weights={"a": 0.9997, "b": 0.0003}, frame=100).toPandas()
    b = np.sort(s.loc[s["source"] == "b", "slot"].to_numpy())
    assert len(b) == 4 and all(k / 0.0003 - 1 < t < (k + 1) / 0.0003 + 1 for k, t in enumerate(b))


def test_more_sources_than_one_frame_s(spark):
    d = spark.createDataFrame([(i, f"s{i % 1300}" if i % 3 else "big") for i in range(9000)], "doc_id long, source string")
    s = mixing.schedule(d, block=1).toPandas()
    assert len(s) == 9000 and s["slot"].notna().all() and not s["slot"].duplicated().any()
    big = np.sort(s.loc[s["source"] == "big", "slot"].to_numpy())
    counts = s.groupby("source").size() ** 0.5
    share = counts["big"] / counts.sum()
    assert abs((big < 2000).sum() - share * 2000) < 2 + 0.1 * share * 2000  # two blocks, beside the rounding of the weights


def test_mixed_rows_keep_their_order_and_columns(spark):
    rows = [(i, f"t{i}", "a" if i % 3 else "b", None) for i in range(200)] + [(7, "t7", "a", None), (None, None, None, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    d = d.unionByName(spark.createDataFrame([(None, f"n{i}", "a", "z") for i in range(50)], d.schema))
    m = mixing.mixed(d, block=2, frame=10)
    assert m.columns == d.columns and sorted(map(str, m.collect())) == sorted(map(str, d.collect()))
    slot = {r["_id"]: r["slot"] for r in mixing.schedule(d.filter("doc_id > 7"), block=2, frame=10).collect()}
    got = [slot[r["doc_id"]] for r in mixing.mixed(d.filter("doc_id > 7"), block=2, frame=10).collect()]
    assert got == sorted(got)
    assert mixing.mixed(d.limit(0)).count() == 0 and mixing.schedule(d.limit(0)).count() == 0


def test_mixing_is_native(spark, sf):
    plan = queries.op7_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_fast_ids_equal_the_library_s(text):
    text = text.encode("utf-8", "ignore").decode()
    assert packing.encoder(PATH)(text) == _library(text)


_slow = Tokenizer.from_file(PATH)


def _library(text: str) -> list[int]:
    return _slow.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text():
    for t in ("a<|endoftext|>b", "<|endoftext|>", "x <|endoftext"):
        assert packing.encoder(PATH)(t) == _library(t)


@pytest.mark.parametrize("run", [" ", "\n", " \n", "\u00a0", "a", "é", "!?"])
def test_very_long_runs(run):
    text = "one " + run * (1_000_000 // len(run)) + " two"
    assert packing.encoder(PATH)(text) == _library(text)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "\n", "\t ", "x", "7", "\u2003", "<|endoftext|>"]), st.integers(1, 120_000)), max_size=5))
def test_long_runs_in_a_row(parts):
    text = "".join(c * (n if c != "<|endoftext|>" else 1) for c, n in parts)
    assert packing.encoder(PATH)(text) == _library(text)


def check_sequences(rows, tokens):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= tokens
    return by


def test_packing_round_trip(spark, docs):
    rows = [(-1, None), (None, ""), (-2, "word " * 9000), (-3, "same"), (-3, "same")]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = packing.pack_documents(d, PATH, tokens=1024).collect()
    by = check_sequences(got, 1024)
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 1024) * 1.02 + 1
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for r in d.filter("doc_id >= 0 or doc_id = -2").collect():
        ids = np.array([*_library(r.text or ""), 2], "<u4")
        own = sorted(pieces[r.doc_id], key=lambda x: x.piece)
        assert [x.length for x in own[1:]] == [1024] * (len(own) - 1)
        at = 0
        for k, x in enumerate(own):
            assert (x.piece, x.start, x.ids_crc32) == (k, at, zlib.crc32(ids[at : at + x.length].tobytes()))
            at += x.length
        assert at == len(ids)
    assert len(pieces[-3]) == 2 and pieces[-1][0].length == 1
    assert packing.pack_documents(d.limit(0), PATH).count() == 0


def test_all_capacities_hold(spark, docs):
    got = packing.pack_documents(docs, PATH, tokens=512, documents=3, attention=512 * 300).collect()
    for parts in check_sequences(got, 512).values():
        assert len(parts) <= 3 and sum(n * n for _, n in parts) <= 512 * 300


@pytest.mark.parametrize("capacity", [{"documents": 2}, {"attention": 512 * 100}])
def test_each_capacity_binds(spark, docs, capacity):
    """A capacity alone needs more sequences than the tokens do, and no sequence exceeds it."""
    free = packing.pack_documents(docs.filter("length(text) < 900"), PATH, tokens=512).collect()
    tight = packing.pack_documents(docs.filter("length(text) < 900"), PATH, tokens=512, **capacity).collect()
    parts = check_sequences(tight, 512).values()
    most = lambda rows: max(map(len, rows)) if "documents" in capacity else max(sum(n * n for _, n in p) for p in rows)
    limit = next(iter(capacity.values()))
    assert most(parts) <= limit < most(check_sequences(free, 512).values())
    assert len({r.sequence_id for r in tight}) > len({r.sequence_id for r in free})


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20), st.sampled_from(["norm", "dot"]))
def test_plans_place_every_piece_once(counts, select):
    placed = collections.Counter()
    used = collections.defaultdict(list)
    for length, rank, n, each, first, offset in packing.plan(counts, 64, 5, 64 * 64, select=select):
        assert rank == placed[length]
        placed[length] += n * each
        for s in range(first, first + n):
            for k in range(each):
                used[s].append((offset + k * length, length))
    assert placed == collections.Counter(counts)
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64 and len(parts) <= 5


def test_pipeline(spark):
    import corpus_pipeline as p

    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    labels = spark.read.parquet(f"{where}/labels.parquet")
    from plumbline.llm.common import stored

    clean = stored(p.drop_toxic(spark, docs, where), "t")
    gone = docs.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert clean.columns == docs.columns and gone.agg(F.avg("toxic")).first()[0] > 0.8
    lines = stored(p.drop_common_lines(spark, clean, where), "l")
    assert lines.columns == docs.columns and lines.count() == clean.count()
    assert lines.filter("n_chars <> length(text)").count() == 0
    one = stored(p.drop_near_copies(spark, lines, where), "n")
    from plumbline.llm import simhash

    assert one.count() == simhash.near_duplicates(lines).select("component_id").distinct().count()
    mixed = stored(p.mix_sources(spark, one, where), "m")
    assert sorted(r[0] for r in mixed.select("doc_id").collect()) == sorted(r[0] for r in one.select("doc_id").collect())
    packed = p.pack_sequences(spark, mixed, where).collect()
    check_sequences(packed, 1024)
    assert {r.doc_id for r in packed} == {r[0] for r in mixed.select("doc_id").collect()}
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]


def test_packing_follows_the_mix(spark):
    """Other weights give other sequences; sequences are numbered by their earliest piece in the mix."""
    from plumbline.llm.common import stored

    rows = [(i, "word " * (1 + i % 40), "ab"[i % 2]) for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = []
    for weights in ({"a": 9.0, "b": 1.0}, {"a": 1.0, "b": 9.0}):
        options = {"block": 2, "weights": weights, "frame": 10}
        packed = packing.pack_documents(stored(mixing.mixed(d, **options), "m"), PATH, tokens=64, follow=True).collect()
        slot = {r["_id"]: (r["slot"], r["position"]) for r in mixing.schedule(d, **options).collect()}
        check_sequences(packed, 64)
        assert sorted(r.doc_id for r in packed) == list(range(1200))
        first = {}
        for r in packed:
            first[r.sequence_id] = min(first.get(r.sequence_id, slot[r.doc_id]), slot[r.doc_id])
        assert sorted(first) == list(range(len(first))) and [first[k] for k in sorted(first)] == sorted(first.values())
        got.append({(r.doc_id, r.sequence_id, r.offset) for r in packed})
    assert got[0] != got[1]
    assert packing.pack_documents(d.limit(0), PATH, follow=True).count() == 0


def _recall(spark, v: np.ndarray, step: int, shift: float = 0.0) -> float:
    """Share of the exact ten nearest; with a shift the queries aren't in the index."""
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(8)
    q = spark.createDataFrame([(i, (v[i] + shift).tolist()) for i in range(0, len(v), step)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(e, q, k=10).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect()
    hits = 0
    for r in got:
        d = ((v - v[r.query_id] - shift) ** 2).sum(1)
        d[r.query_id] = np.inf
        hits += len(set(r.ids) & set(np.argsort(d)[:10].tolist()))
    return hits / (10 * len(range(0, len(v), step)))


def test_recall_beside_one_large_vector(spark):
    v = np.random.default_rng(1).normal(size=(12_000, 16))
    v[7] *= 1e6
    v[9] = 1e6
    assert _recall(spark, v, 100) > 0.9


def test_recall_in_many_tight_groups(spark):
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(400, 8)), 30, 0) + rng.normal(size=(12000, 8)) * 1e-5
    assert _recall(spark, v, 60) > 0.95
    assert _recall(spark, v, 60, shift=1e-6) > 0.95
