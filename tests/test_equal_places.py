"""Equal places, windows and lines are looked at once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from plumbline.functions import tables
from plumbline.operators import damage


def plan(d) -> str:
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_equal_windows_meet_equal_places_once(spark):
    rows = [(i, "mould", "wall", i, "u", 1.0 + i % 2 * 2, 0.5, 0.9, 1.0, 0.1, "minor") for i in range(2000)]
    g = spark.createDataFrame(rows, "damage_id long, class string, kind string, room long, axis string, coord double, a0 double, a1 double, height double, extent double, severity string")
    rooms = spark.createDataFrame([(-1, "Room")], "room long, type string")
    adjacent = spark.createDataFrame([(-1, -2)], "a long, b long")
    windows = spark.createDataFrame([("u", 1.05, 1.4, 2.0)] * 2000, "axis string, coord double, a double, b double")
    d = damage.concealed_flags(g, rooms, adjacent, windows, [])
    assert sorted((r.damage_id, r.rule) for r in d.collect()) == [(i, "R4-condensation") for i in range(0, 2000, 2)]
    assert re.search(r"Aggregate \[[^\]]*_wc#", plan(d)) and re.search(r"Aggregate \[[^\]]*coord#\d+[^\]]*a0#\d+[^\]]*a1#\d+", plan(d)), plan(d)


def test_equal_lines_are_drawn_once(spark):
    rows = [(i, i % 3, 0, i % 3 + 4, 2) for i in range(60)] + [(99, None, 0, 1, 1)]
    d = tables.with_line_cells(spark.createDataFrame(rows, "id long, r0 int, c0 int, r1 int, c1 int"), ("r0", "c0", "r1", "c1"), F.count_distinct("r", "c").alias("n"))
    assert d.columns == ["id", "r0", "c0", "r1", "c1", "n"]
    assert sorted((r.id, r.n) for r in d.collect()) == [(i, 5) for i in range(60)]
    text = plan(d)
    assert "Aggregate" in text[text.index("UDTF") :]
