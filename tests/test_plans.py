"""Frames to clouds, drift, photo rooms, damage: small synthetic cases with known answers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import frames, plan2d
from plumbline.plans import damage, drift, known_room, photo


def test_cloud_of_a_wall(spark):
    """A wall 2 m ahead of a camera that looks along z: normals face it, the cloud is flat, seen from two places it is voxel-reduced."""
    px = [("c", f, r, c, 2.0, 2, 50.0, 50.0, 10.0, 8.0) for f in (0, 1) for r in range(16) for c in range(20)]
    pixels = spark.createDataFrame(px, "capture_id string, frame_id long, row int, col int, depth double, conf int, fx double, fy double, cx double, cy double")
    eye = {f"r{i}{j}": float(i == j) for i in range(3) for j in range(3)}
    poses = spark.createDataFrame(pd.DataFrame([{"capture_id": "c", "frame_id": f, **eye, "x": 1.0, "y": 0.0, "z": 0.0} for f in (0, 1)]))
    got = frames.build_cloud(pixels, poses).toPandas()
    assert len(got) == 14 * 18 and got["frame_id"].eq(0).all()  # the border has no normals
    assert np.allclose(got["z"], 2) and np.allclose(got[["nx", "ny", "nz"]], [0, 0, -1])
    assert frames.normals(frames.camera_points(pixels.withColumn("conf", F.lit(1)))).count() == 0
    assert frames.level_frames(poses).count() == 2


def test_drift_is_found_and_taken_back(spark):
    """Two rounds through a room, the second seen shifted: anchors pull the rounds together, and walls lie nearer to one another."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(8000):
        s = int(rng.integers(0, 4))  # segments 0 and 2 see two walls, 1 and 3 the others
        axis, at, along = ("u", 4.0 * (s % 2), rng.uniform(0, 3)) if k % 2 else ("v", 3.0 * (s % 2), rng.uniform(0, 4))
        u, v = (at, along) if axis == "u" else (along, at)
        if s >= 2:
            u, v = u + 0.06, v - 0.05
        rows.append(("c", 1200 * s + int(rng.integers(0, 1200)), u + rng.normal(0, 0.002), v + rng.normal(0, 0.002), axis))
    p = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "frame", "u", "v", "axis"])).withColumn("at", F.when(F.col("axis") == "u", F.col("u")).otherwise(F.col("v")))
    cams = spark.createDataFrame([("c", f, 2.0, 1.5) for f in range(4800)], "k string, frame long, cu double, cv double")
    new, report = drift.correct_drift(p.checkpoint(), cams, ["k"], segment=1200)
    r = report.first()
    assert 0.04 < r["ghosting_raw"] < 0.07 and r["ghosting"] < 0.95 * r["ghosting_raw"]
    assert new.count() == p.count() and (r["segments"], r["anchors"]) == (4, 4) and 0.003 < r["max_correction"] < 0.06
    off, on = (drift.correct_drift(p, cams, ["k"], segment=1200, mode=m)[1].first()["apply"] for m in ("off", "on"))
    assert (off, on) == (False, True)


def test_anchors_weigh_by_inliers_and_overlap(spark):
    """Half of a segment has no counterpart: its weight is about half; a segment with too few points that overlap has no anchor."""
    from plumbline.operators import register

    rng = np.random.default_rng(8)
    wall = np.r_[np.c_[rng.uniform(0, 4, 400), np.zeros(400)], np.c_[np.zeros(300), rng.uniform(0, 3, 300)]]
    away = np.c_[rng.uniform(20, 24, 700), np.full(700, 9.0)]
    rows = pd.concat([pd.DataFrame(x, columns=["u", "v"]).assign(segment=s) for s, x in ((0, wall), (20, np.r_[wall + [0.04, -0.03], away]), (40, wall[:150]))])
    a = register.anchors(spark.createDataFrame(rows.astype({"segment": "int64"})), keys=[], segment_s=1.5).toPandas().set_index("segment")
    assert set(a.index) == {0, 20} and a["weight"][0] > 0.9 and 0.4 < a["weight"][20] < 0.55
    assert abs(a["du"][20] + 0.04) < 0.02 and abs(a["dv"][20] - 0.03) < 0.02
    d = spark.createDataFrame([(0, 0.0, 1.0), (1, None, None), (2, 0.1, 1.0), (3, 0.1, 0.01)], "segment long, du double, weight double")
    strong, weak = (register.pose_graph(d.withColumn("weight", F.when(F.col("segment") == 2, F.lit(w)).otherwise(F.col("weight"))), keys=[], values=["du"], weight="weight").orderBy("segment").toPandas()["du"][2] for w in (1.0, 0.01))
    assert strong > 1.5 * weak


def test_photo_rooms(spark):
    rects = spark.createDataFrame([("h", 1, 0.0, 4.0, 0.0, 3.0), ("h", 2, 0.0, 3.0, 0.0, 2.0), ("h", 3, 0.0, 2.0, 0.0, 2.0), ("h", 4, 0.0, 1.0, 0.0, 1.0)], "capture_id string, room int, u0 double, u1 double, v0 double, v1 double")
    links = spark.createDataFrame([("h", 1, 2, math.pi / 2 + 0.02, 6.0, 0.0, 500, 0.05), ("h", 3, 2, 0.0, -3.0, 0.0, 400, 0.02), ("h", 1, 4, 0.0, 1.0, 1.0, 30, 0.01), ("h", 1, 3, 0.0, 50.0, 0.0, 900, 0.9)], "capture_id string, room_a int, room_b int, yaw double, du double, dv double, inliers int, residual double")
    out, overlaps, near = photo.plan_photo_rooms(rects, links)
    got = {r["room"]: r for r in out.collect()}
    # room 2 is turned a quarter about its origin and moved to u = 6; room 3 lies 3 m along room 2's own u
    assert [round(got[2][c], 6) for c in ("u0", "u1", "v0", "v1")] == [4.0, 6.0, 0.0, 3.0]
    assert [round(got[3][c], 6) for c in ("u0", "u1", "v0", "v1")] == [4.0, 6.0, 3.0, 5.0]
    assert not got[4]["placed"] and got[4]["u0"] >= 7
    assert {(r["a"], r["b"]) for r in near.collect()} == {(1, 2), (2, 3)} and overlaps.count() == 0


def test_damage_scan(spark):
    px = [(f, 1, a, 0, x + 90 * a, y, 1.0, 1.0, 80.0, 80.0, 400, 200) for f in range(3) for a in range(2) for x in range(10, 80, 1) for y in range(10, 80, 1)]
    pixels = spark.createDataFrame(px, "frame int, surface_id int, a int, b int, x int, y int, d double, cos double, fx double, fy double, width int, height int")
    bad, plain = [0.7, 0.0, 0.2, 0.0, 0.1, 0.0, 0.0], [0.0, 0.0, 0.05, 0.0, 0.95, 0.0, 0.0]
    probs = spark.createDataFrame([(f, 1, a, 0, bad if a == 0 else plain, 0.9) for f in range(3) for a in range(2)], "frame int, surface_id int, a int, b int, probs array<double>, surface_p double")
    surfaces = spark.createDataFrame([(1, "wall", 7, "u", 0.0)], "surface_id int, kind string, room int, axis string, coord double")
    rooms = spark.createDataFrame([(7, "Bathroom")], "room int, type string")
    adjacent = spark.createDataFrame([], "a int, b int")
    windows = spark.createDataFrame([("u", 0.05, 0.5, 1.5)], "axis string, coord double, a double, b double")
    d = damage.scan_damage(pixels.withColumn("k", F.lit(0)), probs.withColumn("k", F.lit(0)), surfaces.withColumn("k", F.lit(0)), rooms.withColumn("k", F.lit(0)), adjacent.withColumn("k", F.lit(0)), windows.withColumn("k", F.lit(0)), ["k"])
    r = d.regions.collect()
    assert len(r) == 1 and r[0]["class"] == "mould" and round(r[0]["area"]["value"], 3) == 0.16 and round(r[0]["area"]["ci95"], 3) == 0.096
    assert round(r[0]["confidence"], 9) == 0.9 and r[0]["severity"] is None
    assert {x["rule"] for x in d.flags.collect()} == {"R2-rising-damp", "R3-wet-room-wall", "R4-condensation"}
    assert {(x["qty"], x["unit"]) for x in d.scope.collect()} == {(1.0, "m2"), (1.0, "ea")} and d.scope.count() == 4
    assert d.inspected.first()["tiles"] == 2


def test_cracks_are_major_by_their_tiles(spark):
    from plumbline.operators.damage import concealed_flags, regions

    t = spark.createDataFrame([(1, a, 0, "crack", told, 2, 0.8) for a, told in enumerate(["major_crack", "major_crack", "minor_crack"])] + [(1, a, 5, "crack", told, 2, 0.8) for a, told in enumerate(["major_crack", "minor_crack"])], "surface_id int, a int, b int, class string, told string, views int, confidence double")
    got = {r["b0"]: r["severity"] for r in regions(t, []).collect()}
    assert got[0.0] == "major" and got[2.0] == "minor"
    r = spark.createDataFrame([(1, "crack", "major", 0.1), (2, "crack", "minor", 0.1), (3, "mould", None, 0.9)], "damage_id int, class string, severity string, extent double").selectExpr("*", "'wall' AS kind", "1 AS room", "'u' AS axis", "0.0D AS coord", "0.0D AS a0", "1.0D AS a1", "1.0D AS height")
    no = lambda schema: spark.createDataFrame([], schema)
    flags = concealed_flags(r, no("room int, type string"), no("a int, b int"), no("axis string, coord double, a double, b double"), [])
    assert [tuple(x) for x in flags.collect()] == [(1, "R5-structural-crack")]


def test_barriers_close_doors(spark):
    p = known_room.points_m(spark, "/root/testdata/sf0.1")
    walls = plan2d.wall_families(p, (0.25, 2.4), ["capture_id"])
    cells = plan2d.oriented_walls(walls, ["capture_id"], 0.1).checkpoint()
    bar = plan2d.barrier(cells, ["capture_id"], 14)
    door = bar.filter("c between 24 and 25 and r between 13 and 19").select("r").distinct().count()
    assert door == 7 and cells.filter("axis = 'u' and c between 24 and 25 and r between 14 and 18").count() == 0


def test_quarter_turns_of_the_plan_agree(spark):
    """The known room turned by 90 degrees has the same rooms."""
    from plumbline.plans.capture import plan_capture

    p = known_room.points_m(spark, "/root/testdata/sf0.01")
    turned = p.withColumns({"u": 3.0 - F.col("v"), "v": F.col("u"), "nu": -F.col("nv"), "nv": F.col("nu")})
    areas = sorted(round(r["area"]["value"], 2) for r in plan_capture(turned, ["capture_id"], cover=0.30).rooms.collect())
    assert areas == [4.5, 7.5]
