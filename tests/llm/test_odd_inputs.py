"""Every operator and every pipeline stage over odd rows: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import collections

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import compression, language, language_model, line_dedup, mixing, neighbours, packing, quality, repetition, simhash, toxicity
from plumbline.llm.common import stored, stored_alone

CLASH = ["_id", "_text", "_h", "_key", "_m", "key", "score", "shard", "blob", "slot", "block", "_source", "_order", "fp", "root", "component_id", "kept_id", "length", "piece", "_file", "_row", "hi", "keep", "row", "Score", "a.b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASH if c != "Score")
TEXTS = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (None, None, None, None), (None, "x y z", None, None), (2, "", "en", "s"), (3, "idiot moron words", "de", None), (4, "word " * 200_000, "en", "s"), (5, " \n" * 300_000, "en", "t"), (6, "x" * 300_000, "en", "t")]
ROWS = [(i, t, lang, s, None if t is None else len(t), *["?"] * (len(CLASH) - 1)) for i, t, lang, s in TEXTS]


@pytest.fixture(scope="module")
def odd(spark):
    return stored(spark.createDataFrame(ROWS, SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1), (4, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")


def test_a_row_for_a_row(odd, labels):
    """Operators that judge or measure documents give one row for each, and none for an empty table."""
    makers = {
        "quality": lambda d: compression.scored(d, quality.fit(odd, labels)),
        "toxicity": lambda d: compression.scored(d, toxicity.fit(odd, labels)),
        "language model": lambda d: language_model.scored(d, language_model.build(odd)),
        "line dedup": lambda d: line_dedup.digests(d, line_dedup.keep_bitmaps(d, min_docs=2)),
        "simhash": simhash.near_duplicates,
        "repetition": repetition.repetition,
        "mixing": mixing.schedule,
        "language": lambda d: language.identified(d, language.fit(odd)),
    }
    ids = collections.Counter(r[0] for r in TEXTS)
    for name, make in makers.items():
        rows = make(odd).collect()
        assert collections.Counter(r["_id" if name == "mixing" else "doc_id"] for r in rows) == ids, name
        assert make(odd.limit(0)).count() == 0, name


def test_pieces_cover_every_text(odd):
    import public_tokenizers

    got = packing.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    whole = collections.defaultdict(int)
    for r in got:
        whole[r.doc_id] += r.length
    assert whole[1] == 2 * (6 + 1) and whole[2] == 1 and len(whole) == 7


def test_vectors_beside_clashing_columns(spark):
    d = spark.createDataFrame([(i, [float(i % 7), 1.0], "?", "?", "?") for i in range(40)] * 2, "vec_id long, embedding array<double>, id string, vec string, members string")
    got = neighbours.nearest(d, d.filter("vec_id = 0"), k=3).collect()
    assert len(got) == 6 and {r["query_id"] for r in got} == {0}


@pytest.fixture(scope="module")
def folder(spark, odd, labels, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{where}/documents.parquet")
    labels.write.parquet(f"{where}/labels.parquet")
    return where


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, folder, name, stage):
    out = stage(spark, odd, folder)
    assert name == "best_fit_packing" or out.columns == odd.columns
    rows = out.collect()
    ids = {r["doc_id"] for r in rows}
    assert ids <= {r[0] for r in TEXTS}
    if name in ("mix_sources", "line_dedup"):
        assert len(rows) == len(ROWS)
    if name == "simhash_near_dedup":  # null, empty and white-space texts share the fingerprint zero
        assert ids == {None, 1, 2, 3, 4, 6} and len(rows) == 6
    if name == "best_fit_packing":
        assert ids == {r[0] for r in TEXTS}
    assert stage(spark, stored(odd.limit(0), "none"), folder).count() == 0


def test_the_whole_pipeline(spark, folder, tmp_path):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} >= {None, 1, 2, 4, 6}
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_on_the_way_are_deleted(spark, odd):
    import os

    from plumbline.llm.common import shared_dir

    folder = f"{shared_dir(spark)}/plumbline".removeprefix("file:")
    before = set(os.listdir(folder))
    kept = stored_alone(spark, lambda: simhash.keep_one(odd), "kept")
    assert set(os.listdir(folder)) - before == {os.path.basename(kept._plumbline_path)} and kept.count() == 6


def test_white_space_runs_of_any_length():
    """The check for very long white space, and the encoder, take time linear in the text whatever its runs are."""
    import re
    import time

    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for least, n in ((1, 1), (3, 40), (7, 100)):
        for seed in range(60):
            rng = np.random.default_rng(seed)
            text = "".join(rng.choice(list(" \n　ab"), n, p=[0.3, 0.2, 0.3, 0.1, 0.1]))
            assert packing.has_long_space(text, least) == bool(re.search(r"\s{%d}" % least, text))
    for run in (1, 2, 100, 4_999, 20_000, 49_999, 50_000, 60_000):
        text = ("word" + " " * run) * (1_000_000 // (run + 4))
        began = time.time()
        ids = encode(text)
        assert time.time() - began < 5, run
        assert ids == encode.slow.encode(text, add_special_tokens=False).ids


def test_one_long_text_of_many_lines():
    """Line keys, kept lines and repetition of one text hold little beside it."""
    import hashlib
    import time
    import tracemalloc

    import pyarrow as pa

    text = b"".join(b"%d\n" % (i % 4000) for i in range(1_000_000))  # 5 MB
    batch = pa.RecordBatch.from_pydict({"_id": pa.array([1]), "_th": pa.array([2]), "_text": pa.array([text], pa.binary())})
    began = time.time()
    tracemalloc.start()
    n = sum(b.num_rows for b in line_dedup.line_keys(1)(iter([batch])))
    assert n == 1_000_001
    bits = np.ones(1_000_001, np.uint8)
    bits[::3] = 0
    import zlib

    keep = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
    digest = hashlib.sha256()
    for piece in line_dedup.kept_pieces(np.frombuffer(text, np.uint8), 1_000_001, keep):
        digest.update(piece)
    lines_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    m = repetition.measure_long(np.frombuffer(text, np.uint8), (5, 10), piece=1 << 18, most=1 << 18)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert digest.hexdigest() == hashlib.sha256(b"\n".join(x for x, b in zip(text.split(b"\n"), bits, strict=True) if b)).hexdigest()
    assert m["n_words"][0] == m["n_repeat_words"][0] == m["n_lines"][0] == 1_000_000 and m["n_dup_lines"][0] == 996_000
    assert lines_peak < 60e6 and peak < 60 * 1_000_000 and time.time() - began < 90


def test_long_texts_are_measured_alike():
    """Pieces, spans and parts of the hash range make no difference to what is counted."""
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(0, 400))
        text = "".join(rng.choice(["a", "bé", "c#", " ", "\n", " \n", "\t"], n)).encode()
        data = np.frombuffer(text, np.uint8)
        a = repetition.measure(data, np.array([0, len(data)]), (2, 3, 5), 3)
        b = repetition.measure_long(data, (2, 3, 5), 3, piece=int(rng.integers(1, 50)), most=int(rng.integers(1, 60)))
        assert {k: v.tolist() for k, v in a.items()} == {k: v.tolist() for k, v in b.items()}
        bits = rng.integers(0, 2, text.count(b"\n") + 1).astype(np.uint8)
        import zlib

        keep = zlib.compress(np.packbits(bits, bitorder="little").tobytes())
        expected = b"\n".join(x for x, k in zip(text.split(b"\n"), bits, strict=True) if k)
        assert b"".join(line_dedup.kept_pieces(data, len(bits), keep, int(rng.integers(1, 20)))) == expected == line_dedup.kept_lines(text, len(bits), keep)
        assert [x for lines in line_dedup.line_pieces(data, int(rng.integers(1, 20))) for x in lines] == text.split(b"\n")
