"""Plan registration refined by ICP; outer walls, filled gaps and partitions of a plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import plan2d, register


def test_offsets_are_refined(spark):
    """A plan turned by a quarter and 1.5 degrees and moved off the search's grid comes back nearer than the search alone brings it."""
    walls = [np.c_[np.arange(0, 4, 0.02), np.zeros(200)], np.c_[np.arange(0, 4, 0.02), np.full(200, 3.0)], np.c_[np.zeros(150), np.arange(0, 3, 0.02)], np.c_[np.full(60, 2.5), np.arange(0, 1.2, 0.02)]]
    b = np.concatenate(walls)
    turn = lambda yaw: np.array([[np.cos(yaw), -np.sin(yaw)], [np.sin(yaw), np.cos(yaw)]])
    a = (b - [0.33, -0.21]) @ turn(np.radians(91.5))  # laid back by 91.5 degrees and the shift
    frame = lambda x: spark.createDataFrame(pd.DataFrame(x, columns=["u", "v"]))
    got = register.plan_registration(frame(a), frame(b), half=8).first()
    quarter = np.linalg.matrix_power(np.array([[0, -1], [1, 0]]), got.k)
    laid = a @ quarter.T @ turn(got.yaw).T + [got.du, got.dv]
    found = register.offset_search(frame(a), frame(b), half=8).orderBy(F.desc("share"), "k", "du", "dv").first()
    before = a @ quarter.T + [found.du, found.dv]
    assert got.k == 1 and abs(np.degrees(got.yaw) - 1.5) < 0.6 and got.inliers > 0.95
    assert np.abs(laid - b).max() < 0.04 < np.abs(before - b).max()
    assert register.plan_registration(frame(a).limit(0), frame(b), half=2).count() == 0


def test_walls_of_a_plan(spark):
    """Two rooms that share an edge, and a third behind a double-faced wall of 0.3 m: the gap is wall, the shell runs round all, the shared edge is a partition."""
    rows = [(1, 0, 0, 0.0, 2.0, 0.0, 3.0), (2, 1, 0, 2.0, 4.0, 0.0, 3.0), (3, 3, 0, 4.3, 6.0, 0.0, 3.0)]
    rooms = spark.createDataFrame(rows, "room int, i int, j int, u0 double, u1 double, v0 double, v1 double")
    p = plan2d.partitions(rooms, []).collect()
    assert len(p) == 1 and (p[0].room_a, p[0].room_b, round(p[0].u0, 3), round(p[0].u1, 3), p[0].v0, p[0].v1) == (1, 2, 1.945, 2.055, 0.0, 3.0)
    cells = {(r.r, r.c) for r in plan2d.wall_cells(rooms, [], 0.1).collect()}
    inside = {(r, c) for r in range(30) for c in [*range(40), *range(43, 60)]}
    want = {(r, c) for r in range(-2, 32) for c in range(-2, 62)} - inside
    assert cells == want
    assert plan2d.wall_cells(rooms.filter(F.col("room") < 3), [], 0.1).count() == 34 * 44 - 30 * 40
