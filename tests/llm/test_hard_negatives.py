"""Hard negatives against brute force: ties, repeats, nulls, large components, vectors of several lengths."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives, queries
from tests.oracle import assert_same, connect


def brute(rows, anchor, scale=256, positives=5, negatives=5):
    """rows: (id, label, vector)"""
    take = []
    for i, (key, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            take.append((i, key, label, [math.floor(scale * x) for x in v]))
    late = lambda x: (x is None, x or 0)
    out = []
    for i, key, label, q in take:
        if key is None or not anchor(key):
            continue
        scored = [(max(-(2**63) + 2, min(2**63 - 1, sum(a * b for a, b in zip(q, p, strict=False)))), k, m == label) for j, k, m, p in take if j != i]
        scored.sort(key=lambda x: (-x[0], late(x[1])))
        for score, pos, _ in [x for x in scored if x[2]][:positives]:
            near = [x for x in scored if not x[2] and 80 * score <= 100 * x[0] <= 100 * score][:negatives]
            out += [(key, pos, r, neg, score, s) for r, (s, neg, _) in enumerate(near, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, kind="array<double>", **more):
    d = spark.createDataFrame([(*r, "?", "?") for r in rows], f"vec_id long, label int, embedding {kind}, q string, r string")
    got = hard_negatives.mine(d, anchors=F.col("id") % 5 == 0, **more).collect()
    return sorted((tuple(r)[:6] for r in got), key=repr)


@pytest.mark.parametrize("shard,block,leaf", [(8192, 4096, 64), (40, 7, 3)])
def test_whole_results(spark, monkeypatch, shard, block, leaf):
    for name, value in (("SHARD", shard), ("BLOCK", block)):
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(hard_negatives.BallTree.__init__, "__defaults__", (leaf,))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6))
    rows = [(i, int(rng.integers(4)), [float(x) for x in np.round(centres[i % 4] + rng.normal(size=6) * 0.3, 1)]) for i in range(240)]
    rows += rows[:20] + [(1000 + i, i % 4, rows[3][2]) for i in range(60)]
    assert mined(spark, rows) == brute(rows, lambda k: k % 5 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (5, 2, [1.0, 2.0, 3.0]), (6, 1, [1.0]), (7, 2, []), (10, 1, None), (15, None, [1.0, 1.0]), (None, 1, [1.0, 2.0]), (None, 2, [0.9, 2.0]),
        (20, 1, [nan, 1.0]), (25, 1, [inf, 1.0]), (30, 1, [None, 1.0]), (31, 2, [0.99, 2.0]), (32, 2, [0.5, 2.0]), (35, 3, [-1.0, -2.0]), (40, 3, [1.0, 2.0]), (41, 3, [0.0, 0.0]), (45, 4, [0.0, 0.0]),
    ]
    assert mined(spark, rows) == brute(rows, lambda k: k % 5 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) * 10.0 ** int(rng.integers(0, 7)) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(100, 0, [1e300, 1.0, 0.0]), (101, 0, [1e12, 3.0, 1.0]), (102, 1, [1e12, 2.0, 5.0]), (105, 1, [9e11, 1.0, 1.0])]
    expected = brute([(a, b, [max(min(x, 2.0**54), -(2.0**54)) for x in v]) for a, b, v in rows], lambda k: k % 5 == 0)
    assert mined(spark, rows) == expected


def test_bounds_prune(spark):
    """Far groups of one label each: most leaves are never scored, and the results are still whole."""
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.normal(size=(40, 8)) * 50, 50, 0) + rng.normal(size=(2000, 8))).round()
    labels = np.repeat(np.arange(40) % 2, 50)
    tree = hard_negatives.BallTree(x, labels, 16)
    whole, looked = x[tree.order].astype(np.int64), 0
    plain = hard_negatives.exact_scores

    def counted(q, rows, *more):
        nonlocal looked
        looked += len(q) * len(rows)
        return plain(q, rows, *more)

    hard_negatives.exact_scores = counted
    try:
        q = x[:50].astype(np.int64)
        low, high = np.full(50, -(2**62)), np.full(50, 2**62)
        of, score, _ = hard_negatives.search(tree, whole, tree.order, tree.order, q, labels[:50], np.arange(50), low, high, 5, True)
    finally:
        hard_negatives.exact_scores = plain
    for i in range(50):
        s = q[i] @ x.astype(np.int64).T
        s = np.sort(s[(labels == labels[i]) & (np.arange(2000) != i)])[::-1][:5]
        assert sorted(score[of == i], reverse=True) == s.tolist()
    assert looked < 0.2 * 50 * 2000


def test_against_sql(spark, sf):
    assert_same(queries.op12_hard_negatives(spark, sf), connect(sf), queries.OP12_SQL)
