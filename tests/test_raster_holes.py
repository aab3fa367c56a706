"""Holes across tiles, in empty tiles and at borders, against a flood from outside."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import raster, spatial


def flooded(cells):
    if not cells:
        return set()
    r, c = zip(*cells, strict=True)
    r0, r1, c0, c1 = min(r) - 1, max(r) + 1, min(c) - 1, max(c) + 1
    seen, todo = {(r0, c0)}, [(r0, c0)]
    while todo:
        y, x = todo.pop()
        for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if r0 <= p[0] <= r1 and c0 <= p[1] <= c1 and p not in seen and p not in cells:
                seen.add(p)
                todo.append(p)
    return {(y, x) for y in range(r0, r1 + 1) for x in range(c0, c1 + 1)} - seen


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_filled_as_by_a_flood(spark, tile):
    rng = np.random.default_rng(tile)
    rasters = {i: {(int(r) - 9, int(c) - 15) for r, c in zip(*np.nonzero(rng.random((24, 31)) < p), strict=True)} for i, p in enumerate((0.35, 0.5, 0.6))}
    rasters[5] = {(r, c) for r in range(-20, 21) for c in range(-20, 21) if max(abs(r), abs(c)) == 20}  # a ring round empty tiles
    rasters[6] = rasters[5] - {(-20, 3)}  # an open one
    rasters[7] = {(0, 0)}
    rows = [(k, r, c) for k, cells in rasters.items() for r, c in cells]
    got: dict = {k: [] for k in rasters}
    for x in raster.filled_holes(spark.createDataFrame(rows, "k int, r long, c long"), ["k"], tile).collect():
        got[x.k].append((x.r, x.c))
    for k, cells in rasters.items():
        assert sorted(got[k]) == sorted(flooded(cells)), k
    alone = raster.filled_holes(spark.createDataFrame([x[1:] for x in rows if x[0] == 5], "r long, c long"), [], tile)
    assert alone.count() == 41 * 41
    assert raster.filled_holes(spark.createDataFrame([], "k int, r long, c long"), ["k"]).count() == 0


def test_equal_points_keep_their_surfaces(spark):
    points = spark.createDataFrame([("u", 1.0, 0.5, 0.95, 1.0)] * 3 + [("u", 1.0, 9.0, 0.95, 1.0), ("u", 1.02, 0.5, -0.95, 1.0), ("v", 1.0, 0.5, 0.95, 1.0)], "axis string, at double, along double, n double, h double")
    surfaces = spark.createDataFrame([(2, "u", 1, 1.01, 0.0, 1.0), (1, "u", 1, 0.98, 0.0, 1.0), (3, "u", -1, 1.0, 0.0, 1.0)], "surface_id int, axis string, sign int, coord double, a double, b double")
    got = spatial.first_surface(points, surfaces)
    assert sorted(r.surface_id for r in got.collect()) == [1, 1, 1, 3]


def test_rays_between_equal_cells_are_walked_once(spark):
    rays = spark.createDataFrame([(0.05, 0.05, 1.0, 1.0)] * 50 + [(0.06, 0.07, 1.01, 1.02)] * 50, "u0 double, v0 double, u1 double, v1 double")
    d = raster.ray_cells(rays, 0.1, [])
    assert d.count() == 8 and d.groupBy("r", "c").count().filter("count > 1").count() == 0 and d.agg(F.max("r")).first()[0] == 7


@pytest.mark.parametrize("size", [4, 256])
def test_box_sums_across_tiles(spark, size):
    rng = np.random.default_rng(size)
    cells = [(k, int(r), int(c), int(w)) for k in (1, None) for r, c, w in zip(rng.integers(-20, 30, 400), rng.integers(-15, 25, 400), rng.integers(-3, 9, 400), strict=True)]
    boxes = []
    for i in range(80):
        r, c = sorted(rng.integers(-25, 35, 2).tolist()), sorted(rng.integers(-20, 30, 2).tolist())
        boxes.append((1, i, r[0], r[1], c[0], c[1]))
    boxes.append((1, 99, 5, 4, 0, 3))  # nothing lies in an empty box
    d, b = spark.createDataFrame(cells, "k int, r long, c long, w long"), spark.createDataFrame(boxes, "k int, id int, r0 long, r1 long, c0 long, c1 long")
    mine = [x for x in cells if x[0] == 1]
    for weight in (None, "w"):
        got = {r.id: r.n for r in raster.box_sums(d, b, ["k"], ["id"], size=size, weight=weight).collect()}
        assert got == {i: sum((w if weight else 1) for _, r, c, w in mine if r0 <= r <= r1 and c0 <= c <= c1) for _, i, r0, r1, c0, c1 in boxes}
    alone = raster.box_sums(d.filter("k = 1").drop("k"), b.drop("k"), [], ["id"], size=size)
    assert {r.id: r.n for r in alone.collect()} == {i: sum(r0 <= r <= r1 and c0 <= c <= c1 for _, r, c, _ in mine) for _, i, r0, r1, c0, c1 in boxes}
    assert raster.box_sums(d.limit(0), b, ["k"], ["id"], size=size).agg(F.sum("n")).first()[0] == 0
