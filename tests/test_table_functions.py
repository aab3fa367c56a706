"""Table functions in SQL: folds in the order asked for, lines by whole steps."""

from __future__ import annotations

import pytest

from plumbline.functions import tables


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    tables.register(spark)


def test_folds_in_sql(spark):
    spark.createDataFrame([("a", 3.0, 1.0), ("a", 0.0, 1.0), ("a", 0.03, 1.0), ("a", 0.06, 2.0), ("b", 1.0, 1.0), (None, 2.0, 1.0)], "k string, c double, w double").repartition(3).createOrReplaceTempView("tf_positions")
    got = sorted(map(tuple, spark.sql("SELECT * FROM merged_lines(TABLE(tf_positions) PARTITION BY k ORDER BY (c, w), 0.05D)").collect()), key=str)
    assert [(k, o, round(c, 6), w) for k, o, c, w in got] == [("a", 0, 0.0375, 4.0), ("a", 1, 3.0, 1.0), ("b", 0, 1.0, 1.0), (None, 0, 2.0, 1.0)]
    assert spark.sql("SELECT * FROM merged_lines(TABLE(SELECT * FROM tf_positions WHERE k = 'z') PARTITION BY k ORDER BY (c, w), 0.05D)").count() == 0
    frames = [("x", i, i * 0.1, 0.05, s) for i, s in enumerate([1.0, 2.0, 9.0, 9.0, 1.0, 0.0])]
    spark.createDataFrame(frames, "k string, f long, t double, shift double, sharp double").createOrReplaceTempView("tf_frames")
    got = spark.sql("SELECT frame_id FROM key_frames(TABLE(tf_frames) PARTITION BY k ORDER BY (f), 0.12D, 0.5D, 3, 2)").collect()
    assert [r.frame_id for r in got] == [0, 2]


def test_lines_are_exact(spark):
    rays = [(0, 0, 3, 7), (5, -2, -4, 1), (2, 2, 2, 2), (-3, 4, -3, -4), (0, 0, 6, 6)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rays)] + [(9, None, 0, 1, 1)], "id int, r0 int, c0 int, r1 int, c1 int").createOrReplaceTempView("tf_rays")
    got: dict = {}
    for r in spark.sql("SELECT id, l.r, l.c FROM tf_rays t, LATERAL line_cells(t.r0, t.c0, t.r1, t.c1, 0) l").collect():
        got.setdefault(r.id, []).append((r.r, r.c))
    assert set(got) == set(range(len(rays)))
    for i, (r0, c0, r1, c1) in enumerate(rays):
        cells = got[i]
        assert cells[0] == (r0, c0) and cells[-1] == (r1, c1) and len(set(cells)) == len(cells) == max(abs(r1 - r0), abs(c1 - c0)) + 1
        n = len(cells) - 1
        assert all(abs(r - (r0 + (r1 - r0) * k / max(n, 1))) <= 0.5 and abs(c - (c0 + (c1 - c0) * k / max(n, 1))) <= 0.5 for k, (r, c) in enumerate(cells))
    assert spark.sql("SELECT l.r FROM LATERAL line_cells(0, 0, 0, 9, 3) l").count() == 7
