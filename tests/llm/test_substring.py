"""Substring dedup against brute force: parts of long texts, forced collisions, odd rows."""

from __future__ import annotations

import collections
import hashlib
import time

import numpy as np
import pytest

from plumbline.llm import queries, substring
from tests.oracle import assert_same, connect

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
PASSAGE = " ".join(f"p{i}" for i in range(50))
ROWS = [
    (1, "a b c\nd  e f", "p", "q"), (1, "a b c\nd  e f", "p", "q"), (None, None, "p", "q"), (None, "a b c d e", None, None), (2, "", "p", "q"), (3, " \t\n", "p", "q"),
    (4, LONG, "p", "q"), (5, "x " + LONG[2_000:90_000], "p", "q"), (6, "same " * 20_000, "p", "q"), (7, "y" * 100_000, "p", "q"), (8, PASSAGE + " tail " + PASSAGE[:-3], "p", "q"), (9, "A B C D E F", "p", "q"),
    (10, " a b c d e f ", "p", "q"), (11, "\xa0a b c d e f g", "p", "q"),
]


def brute(rows, k):
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    times = collections.Counter(tuple(w[i : i + k]) for _, w in split for i in range(len(w) - k + 1))
    out = []
    for i, w in split:
        gone = np.zeros(len(w) + k, bool)
        for j in range(len(w) - k + 1):
            if times[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=False) if not y)).hexdigest()))
    return in_order(out)


def in_order(rows):
    return sorted((tuple(r)[:4] for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, _id string, shard string").repartition(3).cache()


@pytest.mark.parametrize("window,size,bits", [(35, 2 << 20, 64), (5, 700, 64), (8, 2 << 20, 6), (35, 1500, 10), (1, 2 << 20, 64)])
def test_words_that_stay(docs, odd, window, size, bits):
    """Long texts come in parts of ``size`` bytes; with hashes of few bits nearly every edge collides and the texts decide."""
    for d in (docs, odd) if bits == 64 else (docs,):
        assert in_order(substring.without_repeats(d, window=window, size=size, bits=bits).collect()) == brute([tuple(r) for r in d.collect()], window)


def test_many_doubtful_edges_are_joined(docs, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_EDGES", 0)
    assert in_order(substring.without_repeats(docs, window=35, bits=8).collect()) == brute([tuple(r) for r in docs.collect()], 35)


def test_paths_are_whole_in_all_their_places(spark):
    """A passage with different surroundings is one path; a branch in its middle makes three of it."""
    w = [f"v{i}" for i in range(20)]
    rows = [(1, " ".join(["a", *w, "b"])), (2, " ".join(["c", *w, "d"])), (3, " ".join(["e", *w[5:12], "f"]))]
    got = {r.doc_id: sorted(tuple(s) for s in r.spans) for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=4).collect()}
    assert got == {1: [(1, 5), (6, 4), (10, 8)], 2: [(1, 5), (6, 4), (10, 8)], 3: [(1, 4)]}


def test_empty_table_and_copies(spark, odd):
    assert substring.without_repeats(odd.limit(0)).count() == 0
    text = " ".join(map(str, range(60)))
    got = substring.without_repeats(spark.createDataFrame([(i % 50, text) for i in range(300)], "doc_id long, text string")).collect()
    assert len(got) == 300 and {(r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(60, 60, hashlib.sha256(b"").hexdigest())}


def test_pieces_and_rolling_hashes():
    rng = np.random.default_rng(5)
    for _ in range(50):
        text = bytes(rng.choice(np.frombuffer(b"ab \n\t", np.uint8), int(rng.integers(0, 300))))
        data = np.frombuffer(text, np.uint8)
        pieces = list(substring.text_pieces(data, int(rng.integers(1, 40))))
        assert b"".join(p.tobytes() for p in pieces) == text and [w for p in pieces for w in p.tobytes().split()] == text.split()
    h = rng.integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 3, 7, 35):
        rolled, least = substring.rolled(h, k), substring.least(h, k)
        same = collections.defaultdict(set)
        for i in range(len(h) - k + 1):
            same[tuple(h[i : i + k])].add(int(rolled[i]))
            assert least[i] == h[i : i + k].min()
        assert len(rolled) == len(h) - k + 1 and all(len(v) == 1 for v in same.values()) and len(set().union(*same.values())) == len(same)


def test_one_long_text_in_little_memory():
    """40 MB in one text: pieces bound what is held beside the text, and time is linear."""
    import tracemalloc

    data = np.frombuffer(b"word and other words in a row \n" * 1_300_000, np.uint8)
    tracemalloc.start()
    began = time.time()
    n, removed, _, _ = substring.measured(data, np.array([5]), np.array([100]), 35, 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, removed) == (7 * 1_300_000, 134) and peak < 60e6 and time.time() - began < 30


def test_against_sql(spark, sf):
    assert_same(queries.op11_substring(spark, sf), connect(sf), queries.OP11_SQL)
