"""Rows of equal shape are matched once: the pairs that a join makes grow with the shapes, the result with the rows."""

from __future__ import annotations

from plumbline.operators import scoring, spatial


def watched(monkeypatch, name):
    """How many rows each call of a step of spatial gives."""
    made, step = [], getattr(spatial, name)

    def run(*a, **k):
        made.append(step(*a, **k))
        return made[-1]

    monkeypatch.setattr(spatial, name, run)
    return made


def test_lifted_boxes_of_copies(spark, monkeypatch):
    made = watched(monkeypatch, "pixels_in_boxes")
    px = spark.createDataFrame([(0, 20 + i % 3, 15, 1.0 + i % 2) for i in range(60)], "frame int, x int, y int, depth double")
    boxes = spark.createDataFrame([(i, 0, 0, 0, 40, 30) for i in range(50)] + [(99, 0, 500, 0, 540, 30)], "box int, frame int, x0 int, y0 int, x1 int, y1 int")
    got = spatial.lifted_detections(px, boxes, ["frame"], "box").collect()
    assert sorted(tuple(r) for r in got) == [(0, i, 1.5, 60) for i in range(50)]
    assert made[0].count() == 6


def test_nearest_in_band_of_copies(spark, monkeypatch):
    made = watched(monkeypatch, "band_match")
    left = spark.createDataFrame([(i, 1, i % 2 * 10) for i in range(40)], "l int, k int, x int")
    right = spark.createDataFrame([(100 + i, 1, 4 + i % 2 * 12) for i in range(40)] + [(7, 2, 0)], "r int, k int, y int")
    got = spatial.nearest_in_band(left, right, "l", "r", "x", "y", 6, ["k"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, i, 0, 100, 4) for i in range(0, 40, 2)]
    assert made[0].count() == 2
    wide = spatial.nearest_in_band(left, right, "l", "r", "x", "y", 7, ["k"]).collect()
    assert {(r["x"], r["r"]) for r in wide} == {(0, 100), (10, 100)} and len(wide) == 40


FACES = "face_id int, axis string, sign int, coord double, a double, b double"


def test_matched_faces_of_copies(spark, monkeypatch):
    made = watched(monkeypatch, "overlap_join")
    a = spark.createDataFrame([(i, "u", 1, 1.0, 0.0, 9.0) for i in range(30)], FACES)
    b = spark.createDataFrame([(100 - i, "u", 1, 1.1, 1.0, 8.0) for i in range(30)] + [(i, "u", 1, 1.3, 0.0, 9.0) for i in range(9)], FACES)
    got = [(r["face_id"], r["other"], round(r["diff"], 6), r["overlap"]) for r in scoring.matched_faces(a, b).collect()]
    assert sorted(got) == [(i, 71, 0.1, 7.0) for i in range(30)]
    assert made[0].count() <= 2


def test_facing_walls_of_copies(spark, monkeypatch):
    made = watched(monkeypatch, "overlap_join")
    f = spark.createDataFrame([(i, "u", 1, 1.0, 0.0, 3.0) for i in range(20)] + [(100 + i, "u", -1, 4.0, 1.0, 9.0) for i in range(10)] + [(200, "u", -1, 30.0, 0.0, 3.0), (201, "u", -1, 9.0, 0.0, 3.0)], FACES)
    got = [tuple(r) for r in scoring.facing_walls(f, []).collect()]
    assert sorted(got) == [(i, 100 + j, 3.0) for i in range(20) for j in range(10)]
    assert made[0].count() <= 2


def test_overlap_area_of_copies(spark, monkeypatch):
    made = watched(monkeypatch, "_shared")
    copies = [(i, 0.0, 2.0, 0.0, 2.0) for i in range(1, 13)] + [(i, 1.0, 5.0, 1.0, 3.0) for i in range(20, 30)]
    parted = [(15, 0.0, 1.0, 0.0, 1.0), (15, 1.0, 2.0, 0.0, 0.5), (16, 0.0, 0.5, 0.0, 1.0), (16, 0.5, 1.5, 0.0, 0.2)]
    rects = copies + parted
    got = spatial.overlap_area(spark.createDataFrame(rects, "room int, u0 double, u1 double, v0 double, v1 double"), "room").collect()
    want: dict = {}
    for x in rects:
        for y in rects:
            du, dv = min(x[2], y[2]) - max(x[1], y[1]), min(x[4], y[4]) - max(x[3], y[3])
            if x[0] < y[0] and du > 0 and dv > 0:
                want[x[0], y[0]] = want.get((x[0], y[0]), 0) + du * dv
    assert sorted((r["a"], r["b"], round(r["area"], 9)) for r in got) == sorted((*k, round(v, 9)) for k, v in want.items() if v > 0.25)
    assert made[0].count() <= 4
