"""Sharpness, thumbnails and motion against brute force, and key frames fed by them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import images
from plumbline.operators import windows


def test_sharpness_pixel_by_pixel(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i, (h, w) in enumerate([(2, 2), (5, 7), (12, 3), (1, 6)]):
        rows.append((i, rng.integers(0, 255, h * w).astype(float).tolist(), w))
    d = spark.createDataFrame([*rows, (9, None, 3), (10, [1.0, 2.0], 3), (11, [], 3)], "id int, image array<double>, w int")
    got = {r.id: r.s for r in d.select("id", images.sharpness("image", "w").alias("s")).collect()}
    assert got.pop(9) is None and got.pop(10) is None and got.pop(11) is None
    for i, flat, w in rows:
        m = np.array(flat).reshape(-1, w)
        h = len(m)
        at = lambda r, c: m[abs(r) if r < h else 2 * h - 2 - r, abs(c) if c < w else 2 * w - 2 - c]  # noqa: B023, E731
        want = np.var([at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * m[r, c] for r in range(h) for c in range(w)]) if min(h, w) > 1 else 0.0
        assert np.isclose(got[i], want)


def test_thumbnails_average_areas(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (24, 60)).astype(float)
    d = spark.createDataFrame([(image.ravel().tolist(), 60)], "image array<double>, w int")
    small = d.select(images.thumbnail("image", "w", 20).alias("t")).first().t
    assert small.w == 20 and np.allclose(np.array(small.pixels).reshape(-1, 20), image.reshape(8, 3, 20, 3).mean((1, 3)), atol=1e-3)
    odd = images.reduced(image, 25)
    assert odd.shape == (10, 25) and np.isclose(odd.mean(), image.mean())
    assert np.isclose(odd[0, 0], (np.r_[1, 1, 0.4] @ image[:3, :3] @ np.r_[1, 1, 0.4]) / 2.4**2)


def scene(rng, x, n=64):
    """A window of a wide smooth random picture, x pixels along."""
    return rng[:, x : x + n]


def test_motion_feeds_key_frames(spark):
    rng = np.random.default_rng(2)
    wide = images.reduced(rng.normal(size=(128, 800)), 400)  # 64 x 400
    wide = (wide - wide.mean()) * 50 + 100
    steps = [0, 1, 2, 3, 12, 24, 36, 37, 38, 39, 48, 60]
    rows = [("c", i, scene(wide, x).ravel().tolist(), 64, i * 0.1) for i, x in enumerate(steps)] + [("d", 0, scene(wide, 0).ravel().tolist(), 64, 0.0), ("d", 1, None, 64, 0.1), ("d", 2, scene(wide, 6).ravel().tolist(), 64, 0.2)]
    d = spark.createDataFrame(rows, "k string, f long, image array<double>, w int, t double").repartition(3)
    got = images.motion(d, "k", "f", "image", "w")
    m = {(r.k, r.f): r for r in got.collect()}
    moved = np.diff(steps) / 64
    assert m["c", 0].shift == 0 and m["d", 0].shift == 0 and np.isclose(m["d", 2].shift, 6 / 64, atol=0.02) and m["d", 1].sharpness is None
    assert np.allclose([m["c", i + 1].shift for i in range(len(moved))], moved, atol=0.02)
    assert np.isclose(m["c", 3].sharpness, images.laplacian_variance(scene(wide, 3)))
    keys = windows.keyframes(got.join(d.select("k", "f", "t"), ["k", "f"]).filter("k = 'c'"), ["k"], "f", "t", "shift", "sharpness", gap_s=100.0).collect()
    assert len(keys) == 4 and all(abs(steps[a.f] - steps[b.f]) >= 6 for a, b in zip(keys, keys[1:], strict=False))
    assert images.motion(d.limit(0), "k", "f", "image", "w").agg(F.count("*")).first()[0] == 0
