"""Thresholds that means of many points lie at, and steps that must not repeat or gather the points of a capture."""

from __future__ import annotations

import numpy as np
import pandas as pd

from plumbline.operators import plan2d, robust, rooms
from plumbline.plans.known_room import points_mm


def test_a_micrometre_does_not_decide_on_a_corridor(spark):
    cells = spark.createDataFrame([("x", 1, 0, 0, 2.499999, 4.0, -0.0000027, 2.9999967)], "k string, room int, i int, j int, u0 double, u1 double, v0 double, v1 double")
    openings = spark.createDataFrame([], "k string, room_a int, room_b int")
    f = rooms.room_features(cells, openings, ["k"])
    assert f.first()["elongation"] == 2.0


def test_points_meet_their_band_without_pairs_of_partitions(spark):
    p = spark.range(100).selectExpr("'x' AS k", "id * 1.0D AS u", "id * 2.0D AS v", "1.0D AS h", "CASE WHEN id % 2 = 0 THEN 1.0D ELSE 0.0D END AS nu", "CASE WHEN id % 2 = 0 THEN 0.0D ELSE -1.0D END AS nv", "0.0D AS ny")
    band = spark.createDataFrame([("x", 0.25, 2.0)], "k string, band_lo double, band_hi double").checkpoint()
    w = plan2d.wall_families(p, band, ["k"])
    assert "CartesianProduct" not in w._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.axis, r.sign, r["at"], r.along) for r in w.collect())
    assert got == sorted([("u", 1, float(i), 2.0 * i) for i in range(0, 100, 2)] + [("v", -1, 2.0 * i, float(i)) for i in range(1, 100, 2)])


def test_filters_on_points_do_not_repeat_their_making(spark, sf):
    plan = points_mm(spark, sf).filter("nh = 1 AND h_mm > 10 AND u_mm < 90")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1299709") == 3  # once each for s, a and b


def test_crispness_gathers_no_axis(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.02, 4000) for c in (1.0, 3.0)])
    d = spark.createDataFrame(pd.DataFrame({"axis": "u", "x": x}))
    got = robust.crispness(d, "x", "axis")
    lo = x.min()
    last = max(np.ceil((x.max() - lo) / 0.01), 1) - 1
    n = np.bincount(np.minimum(np.floor((x - lo) / 0.01), last).astype(int), minlength=int(last) + 1)
    peaks = lo + (np.flatnonzero(n > np.percentile(n, 99)) + 0.5) * 0.01
    dist = np.abs(x[:, None] - peaks[None]).min(1)
    assert abs(got.first()["crispness"] - np.median(dist[dist < 0.1])) < 1e-9
    assert "median(" not in got._jdf.queryExecution().optimizedPlan().toString()
