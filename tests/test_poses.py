"""Composition along trees against the sequential result."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import register


def matrix(m):
    return np.vstack((np.array(m).reshape(3, 4), [0, 0, 0, 1]))


def random_pose(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return np.c_[q * np.sign(np.linalg.det(q)) * rng.uniform(0.999, 1.001), rng.normal(size=3)].ravel().tolist()


def composed(rows):
    parent, own, out = {(k, n): p for k, n, p, _ in rows}, {(k, n): matrix(m) for k, n, _, m in rows}, {}
    for k, n in own:
        path, x = [], n
        while x is not None and (k, x) in own:
            path.append(own[k, x])
            root, x = x, parent[k, x]
        m = np.eye(4)
        for step in path:
            m = step @ m
        out[k, n] = (x if x is not None else root, m)
    return out


SCHEMA = "k string, node long, parent long, m array<double>"


def test_a_chain_of_ten_thousand(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, i - 1 if i else None, random_pose(rng)) for i in range(10_000)]
    got = {r.node: (r.root, matrix(r.m)) for r in register.composed_poses(spark.createDataFrame(rows, SCHEMA), ["k"]).collect()}
    m = np.eye(4)
    for _, i, _, t in rows:
        m = m @ matrix(t)
        assert got[i][0] == 0 and np.allclose(got[i][1], m, atol=1e-6 * max(1, abs(m).max()))


def test_forests_and_frames_of_reference(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in ("a", "b"):
        ids = rng.permutation(200).tolist()
        rows += [(k, n, ids[int(rng.integers(0, i))] if i > 2 else (None if i else 999), random_pose(rng)) for i, n in enumerate(ids)]
    got = {(r.k, r.node): (r.root, matrix(r.m)) for r in register.composed_poses(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"]).collect()}
    want = composed(rows)
    assert set(got) == set(want)
    for key, (root, m) in want.items():
        assert got[key][0] == root and np.allclose(got[key][1], m, atol=1e-9)
    assert register.composed_poses(spark.createDataFrame([], SCHEMA), ["k"]).count() == 0


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError, match="cycle"):
        register.composed_poses(spark.createDataFrame([("a", 1, 2, register.IDENTITY), ("a", 2, 1, register.IDENTITY)], SCHEMA), ["k"], rounds=3)
