"""A whole run: objects, names, damage and document of the known room; splits over doors and by cores."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import plan2d
from plumbline.plans import known_room
from plumbline.plans.run import Capture, run, straightened
from plumbline.sources import sinks
from plumbline.sources.captures import Options

CELLS = "room int, i int, j int, u0 double, u1 double, v0 double, v1 double"


def grid(us, vs, there):
    return [(1, i, j, us[i], us[i + 1], vs[j], vs[j + 1]) for i in range(len(us) - 1) for j in range(len(vs) - 1) if there(i, j)]


def parts(d):
    return {(r.i, r.j): r.part for r in d.collect()}


def test_necks_cross_doors_and_every_part_is_looked_at(spark):
    # two cells of 4 m2 joined by a door edge of 1.5 m, and by nothing else
    cells = spark.createDataFrame(grid([0.0, 2.0, 4.0], [0.0, 2.0], lambda i, j: True), CELLS)
    edges = plan2d.complex_edges(cells, []).withColumns({"kind": F.lit("door"), "b": F.col("a") + 1.5})
    assert len(set(parts(plan2d.neck_splits(cells, edges, [])).values())) == 2
    assert len(set(parts(plan2d.neck_splits(cells, edges.withColumn("b", F.col("a") + 2.0), [], most=1.6)).values())) == 1  # too wide for a neck
    # one cut leaves 8, 4 and 0.5 m2: three parts, and the small one joins none that it doesn't touch
    rows = [(1, 0, 0, 0.0, 4.0, 0.0, 1.0), (1, 0, 1, 0.0, 4.0, 1.0, 2.0), (1, 1, 0, 4.0, 4.5, 0.0, 1.0), (1, 1, 1, 4.0, 8.0, 1.0, 2.0)]
    cells = spark.createDataFrame(rows, CELLS)
    edges = spark.createDataFrame([("v", 1, 0, 0, 0, 1, 0.0, 4.0, "open"), ("u", 1, 0, 0, 1, 0, 0.0, 0.9, "open"), ("u", 1, 0, 1, 1, 1, 1.0, 2.0, "door")], "axis string, line int, i int, j int, i2 int, j2 int, a double, b double, kind string")
    got = parts(plan2d.neck_splits(cells, edges, []))
    assert got[0, 0] == got[0, 1] and len({got[0, 0], got[1, 0], got[1, 1]}) == 3


def test_large_rooms_are_split_by_their_cores(spark):
    """Two halls joined through two passages of 1 m: no line is narrow enough for a neck, but their cores are apart; a third hall is found in the second half."""
    us = [0.0, 4.0, 4.4, 8.4, 8.8, 12.8]
    vs = [0.0, 0.5, 1.5, 2.5, 3.5, 4.0]
    cells = spark.createDataFrame(grid(us, vs, lambda i, j: i % 2 == 0 or j in (1, 3)), CELLS)
    edges = plan2d.complex_edges(cells, []).withColumn("kind", F.lit("open"))
    assert len(set(parts(plan2d.neck_splits(cells, edges, [], most=1.6)).values())) == 1
    got = parts(plan2d.split_by_cores(cells, edges, [], 0.1))
    assert len({got[0, 0], got[2, 0], got[4, 0]}) == 3 and all(got[i, j] == got[i, 0] for i in (0, 2, 4) for j in range(5))
    small = spark.createDataFrame(grid([0.0, 3.0], [0.0, 3.0], lambda i, j: True), CELLS)
    assert set(parts(plan2d.split_by_cores(small, plan2d.complex_edges(small, []).withColumn("kind", F.lit("open")), [], 0.1)).values()) == {0}
    # a wall between the cells of a hall parts its cores as well
    one = spark.createDataFrame(grid([0.0, 4.0, 8.0], [0.0, 3.0, 4.0], lambda i, j: True), CELLS)
    e = plan2d.complex_edges(one, []).withColumn("kind", F.when((F.col("axis") == "u") & (F.col("j") == 0), "wall").otherwise("open"))
    got = parts(plan2d.split_by_cores(one, e, [], 0.1))
    assert got[0, 0] != got[1, 0]


@pytest.fixture(scope="module")
def report(spark):
    points = known_room.points_m(spark, "/root/testdata/sf0.01")
    seen = [("toilet", 1.0 + 0.01 * (i % 5), 1.0, 0.9) for i in range(40)] + [("sink", 0.5, 2.5, 0.8), ("bed", 3.2, 1.5, 0.9), ("bed", 3.25, 1.5, 0.2), ("bed", 3.3, 1.45, 0.7), ("chair", 20.0, 20.0, 0.9), ("chair", 20.0, 20.1, 0.9)]
    key = points.select("capture_id").first()[0]
    of = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("capture_id", F.lit(key))
    px = [(f, 1, a, b, x + 90 * a, y, 1.0, 1.0, 80.0, 80.0, 400, 200) for f in range(3) for a, b in ((0, 0), (1, 0), (3, 0)) for x in range(10, 80, 2) for y in range(10, 80, 2)]
    pixels = of(px, "frame int, surface_id int, a int, b int, x int, y int, d double, cos double, fx double, fy double, width int, height int").withColumn("fx", F.lit(40.0)).withColumn("fy", F.lit(40.0))
    bad = [0.7, 0.0, 0.2, 0.0, 0.1, 0.0, 0.0]
    probs = of([(f, 1, a, 0, bad, 0.9) for f in range(3) for a in (0, 1, 3)], "frame int, surface_id int, a int, b int, probs array<double>, surface_p double")
    surfaces = of([(1, "wall", "v", 0.0, 1.0, 0.02)], "surface_id int, kind string, axis string, coord double, u double, v double")
    return run(Capture(points, detections=of(seen, "class string, u double, v double, conf double"), pixels=pixels, probs=probs, surfaces=surfaces), Options(tier="lidar"), cover=0.30)


def test_objects_are_counted_once(report):
    objects = {(r["class"], r.room): r.views for r in report.plan.objects.collect()}
    assert objects == {("toilet", 1): 40, ("bed", 2): 2, ("chair", None): 2}
    assert {r.room: r.fixtures for r in report.rooms.collect()} == {1: {"toilet": 1}, 2: {"bed": 1}}


def test_names_and_numbers(report):
    assert {(r.room, r.id) for r in report.rooms.collect()} == {(1, "R1"), (2, "R2")}
    assert [r.id for r in report.openings.collect()] == ["O1"] and report.drift is None
    assert all(r.name.startswith(r.type) and r.polygon for r in report.rooms.collect())


def test_damage_is_placed_named_and_summed_up(report):
    regions = {r.damage_id: r for r in report.damage.regions.collect()}
    assert set(regions) == {"D1", "D2"} and regions["D1"].area.value > regions["D2"].area.value and {r.room for r in regions.values()} == {1}
    text = report.summaries.first().summary.split("\n")
    assert len(text) == 3 and text[1].startswith("D1: mould in ") and "0.32 m2" in text[1]


def test_document(report):
    doc = json.loads(sinks.as_json(report.documents, "capture_id").first().json)
    assert doc["tier"] == "lidar" and len(doc["rooms"]) == 2 and doc["openings"][0]["id"] == "O1" and doc["adjacency"] == [{"a": 1, "b": 2}]
    assert {r["name"]: r["fixtures"] for r in doc["rooms"]}


def test_all_points_move_with_their_frames(spark):
    """Forced corrections move points of every kind, turn their normals and leave a capture without cameras alone."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    rows = []
    for k in range(6000):
        s = int(rng.integers(0, 4))
        axis, at, along = ("u", 4.0 * (s % 2), rng.uniform(0, 3)) if k % 2 else ("v", 3.0 * (s % 2), rng.uniform(0, 4))
        u, v = (at, along) if axis == "u" else (along, at)
        if s >= 2:
            u, v = u + 0.06, v - 0.05
        rows.append(("c", 1200 * s + int(rng.integers(0, 1200)), u + rng.normal(0, 0.002), v + rng.normal(0, 0.002), 1.0, float(axis == "u"), float(axis == "v"), 0.0))
    p = spark.createDataFrame(pd.DataFrame(rows, columns=["capture_id", "frame_id", "u", "v", "h", "nu", "nv", "ny"])).checkpoint()
    cams = spark.createDataFrame([("c", f, 2.0, 1.5) for f in range(4800)], "capture_id string, frame_id long, u double, v double")
    new, report = straightened(Capture(p, cams), "capture_id", "on", segment=1200)
    assert report.first().apply and new.count() == 6000 and new.columns == p.columns
    both = p.agg(F.avg("u").alias("u"), F.avg(F.col("nu") ** 2 + F.col("nv") ** 2).alias("n")).first(), new.agg(F.avg("u").alias("u"), F.avg(F.col("nu") ** 2 + F.col("nv") ** 2).alias("n")).first()
    assert abs(both[0].u - both[1].u) > 1e-4 and abs(both[1].n - 1) < 1e-9
    assert straightened(Capture(p), "capture_id", "auto") == (p, None)
