"""Polygons against brute force: crossings, distances, hulls, rectangles over all angles, simplification; odd rings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import polygons


def inside(p, ring):
    odd = False
    for (u0, v0), (u1, v1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (v0 > p[1]) != (v1 > p[1]) and p[0] < (u1 - u0) * (p[1] - v0) / (v1 - v0) + u0:
            odd = not odd
    return odd


def off(p, ring):
    best = np.inf
    for a, b in zip(map(np.array, ring), map(np.array, [*ring[1:], ring[0]]), strict=True):
        d = b - a
        t = min(max(float((p - a) @ d) / float(d @ d), 0), 1) if d.any() else 0
        best = min(best, float(np.hypot(*(p - a - t * d))))
    return best


def star(rng, n, centre, size):
    """A ring without crossings, not convex."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    return (centre + (size * rng.uniform(0.3, 1, n))[:, None] * np.stack((np.cos(angle), np.sin(angle)), 1)).tolist()


@pytest.mark.parametrize("pad,size", [(0.0, 0.5), (0.15, 0.5), (0.3, 0.1), (0.0, 7.0)])
def test_points_in_polygons(spark, pad, size):
    rng = np.random.default_rng(int(pad * 100 + size * 10))
    rings = [(int(k), i, star(rng, int(rng.integers(3, 9)), rng.uniform(-2, 2, 2), 1.5)) for i, k in enumerate(rng.integers(0, 2, 8))]
    points = [(i % 2, i, *rng.uniform(-4, 4, 2).tolist()) for i in range(400)] * 2
    p = spark.createDataFrame(points, "k int, id int, u double, v double")
    g = spark.createDataFrame(rings, "k int, room int, polygon array<array<double>>")
    got = polygons.points_in_polygons(p, g, "u", "v", "room", "room", pad=pad, size=size, keys=["k"], how="left").collect()
    assert len(got) == 800
    for r in got:
        at = np.array([r.u, r.v])
        first = next((i for k, i, ring in rings if k == r.k and (inside(at, ring) or (pad and off(at, ring) <= pad))), None)
        assert r.room == first
    inner = polygons.points_in_polygons(p, g, "u", "v", "room", "room", pad=pad, size=size, keys=["k"])
    assert inner.count() == sum(r.room is not None for r in got)


def test_odd_rings(spark):
    rings = [(1, None), (2, []), (3, [[0.0, 0.0], [4.0, 0.0]]), (4, [[0.0, 0.0], None, [4.0, 0.0], [4.0, None], [4.0, 4.0], [0.0, 4.0]])]
    g = spark.createDataFrame(rings, "room int, polygon array<array<double>>")
    p = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (9.0, 9.0)], "u double, v double")
    assert [tuple(r) for r in polygons.points_in_polygons(p, g, "u", "v", "room", "room").collect()] == [(1.0, 1.0, 4)]
    assert polygons.points_in_polygons(p.limit(0), g, "u", "v", "room", "room").count() == 0
    assert {(r.room, r.n) for r in polygons.polygon_cells(g, 1.0, ["room"]).groupBy("room").agg(F.count("*").alias("n")).collect()} == {(4, 16)}
    assert polygons.simplified(g, 0.1).count() == 4
    assert g.select(F.round(polygons.area(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(0.0)))), 6)).first()[0] == 3.0


def test_cells_are_those_whose_centres_lie_inside(spark):
    rng = np.random.default_rng(4)
    rings = [(i, star(rng, 7, rng.uniform(-1, 1, 2), 2.0)) for i in range(5)]
    got = {(r.room, r.r, r.c) for r in polygons.polygon_cells(spark.createDataFrame(rings, "room int, polygon array<array<double>>"), 0.13, ["room"], origin=(0.01, -0.02)).collect()}
    want = {(i, r, c) for i, ring in rings for r in range(-30, 30) for c in range(-30, 30) if inside(((c + 0.5) * 0.13 + 0.01, (r + 0.5) * 0.13 - 0.02), ring)}
    assert got == want


def test_hulls_merge_from_parts(spark):
    rng = np.random.default_rng(6)
    pts = np.round(rng.normal(size=(3000, 2)), 2)
    rows = [(None if i % 3 == 2 else f"k{i % 3}", *map(float, p)) for i, p in enumerate(pts)] + [("one", 1.0, 2.0)] * 5 + [("line", float(i), 2.0 * i) for i in range(9)] + [("nan", float("nan"), 1.0), ("k0", None, 1.0)]
    d = spark.createDataFrame(rows, "k string, u double, v double").repartition(7)
    for held in (20_000, 5):
        got = {r.k: r.hull for r in polygons.hulls(d, ["k"], "u", "v", held=held).collect()}
        assert set(got) == {"k0", "k1", None, "one", "line"} and got["one"] == [[1.0, 2.0]] and got["line"] == [[0.0, 0.0], [8.0, 16.0]]
        for k in ("k0", "k1", None):
            ring = np.array(got[k])
            step, mine = np.roll(ring, -1, 0) - ring, np.array([r[1:] for r in rows if r[0] == k and r[1] is not None])
            for a, s in zip(ring, step, strict=True):
                assert (s[0] * (mine[:, 1] - a[1]) - s[1] * (mine[:, 0] - a[0]) >= -1e-12).all()  # all on the left of every edge
            assert {tuple(x) for x in ring} <= {tuple(x) for x in mine}
    assert polygons.hulls(d.filter("k = 'one'"), [], "u", "v").first().hull == [[1.0, 2.0]]
    assert polygons.hulls(d.limit(0), ["k"], "u", "v").count() == 0


def test_rectangles_against_all_angles():
    rng = np.random.default_rng(7)
    for _ in range(40):
        p = rng.normal(size=(int(rng.integers(3, 40)), 2)) * rng.uniform(0.1, 5, 2)
        area, long, short, angle = polygons.smallest_rectangle(polygons.hull(p))
        turns = np.linspace(0, np.pi / 2, 2001)
        c, s = np.cos(turns), np.sin(turns)
        wide = np.ptp(p @ np.stack((c, s)), axis=0)
        high = np.ptp(p @ np.stack((-s, c)), axis=0)
        assert area <= (wide * high).min() + 1e-9 and area > (wide * high).min() * 0.98 and np.isclose(area, long * short) and long >= short
        c, s = np.cos(angle), np.sin(angle)
        assert np.isclose(sorted([np.ptp(p @ [c, s]), np.ptp(p @ [-s, c])]), [short, long]).all()
    turned = np.array([[0, 0], [4, 3], [2.5, 5], [-1.5, 2]])
    assert np.allclose(polygons.smallest_rectangle(polygons.hull(turned)), (12.5, 5, 2.5, np.arctan2(3, 4)))
    assert polygons.smallest_rectangle(np.array([[1.0, 1.0]])) == (0, 0, 0, 0) and polygons.smallest_rectangle(np.array([[0.0, 0.0], [3.0, 4.0]]))[:3] == (0, 5, 0)


def test_simplified_rings_stay_near(spark):
    rng = np.random.default_rng(8)
    rings = [(i, star(rng, 60, np.zeros(2), 3.0)) for i in range(5)] + [(9, [[0.0, 0.0], [1.0, 0.001], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]), (10, [[0.0, 0.0], [1e-4, 0.0], [0.0, 1e-4], [1e-4, 1e-4]])]
    before = dict(rings)
    for r in polygons.simplified(spark.createDataFrame(rings, "room int, polygon array<array<double>>"), 0.05).collect():
        assert all(x in before[r.room] for x in r.polygon) and r.polygon[0] == before[r.room][0]
        if r.room < 9:
            assert len(r.polygon) <= 60 and all(off(np.array(x), r.polygon) <= 0.05 + 1e-9 for x in before[r.room])
        elif r.room == 9:
            assert r.polygon == [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
        else:
            assert len(r.polygon) == 4


def test_polygons_on_one_another(spark):
    """Behind a polygon that covers a bin no other is listed there."""
    squares = [(i, [[-0.1 * (i % 3), 0.0], [8.0, -0.1], [8.0 + i % 2, 8.0], [0.0, 8.0]]) for i in range(300)] + [(-1, [[3.0, 3.0], [3.4, 3.0], [3.2, 3.4]])]
    g = spark.createDataFrame(squares, "room int, polygon array<array<double>>")
    p = spark.createDataFrame([(i * 0.37 - 0.5, j * 0.41 - 0.5) for i in range(27) for j in range(24)], "u double, v double")
    hit = polygons.points_in_polygons(p, g, "u", "v", "room", "room", how="left")

    def holds(ring, u, v):
        return sum((a[1] > v) != (b[1] > v) and u < (b[0] - a[0]) * (v - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    assert all(r["room"] == min((k for k, ring in squares if holds(ring, r["u"], r["v"])), default=None) for r in hit.collect())
    edges = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("u0", "v0", "u1", "v1"), e, strict=True)]) for e in ((0, 0, 8, 0), (8, 0, 8, 8), (8, 8, 0, 8), (0, 8, 0, 0))])
    bins = spark.range(100).select(F.floor(F.col("id") / 10).alias("bu"), (F.col("id") % 10).alias("bv"))
    inside = bins.filter(polygons._covers(edges, F.col("bu"), F.col("bv"), 1.0)).collect()
    assert {(r["bu"], r["bv"]) for r in inside} == {(i, j) for i in range(1, 7) for j in range(1, 7)}
