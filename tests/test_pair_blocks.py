"""Pairs of rows are made where arrays of ids meet: they are neither shuffled nor gathered."""

from __future__ import annotations

import pytest

from plumbline.operators import scoring, spatial


def shuffled(spark, run):
    """What ``run`` gives, and the rows that its stages shuffle."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        it, n = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None).iterator(), 0
        while it.hasNext():
            n += it.next().shuffleWriteRecords()
        return n

    before = total()
    got = run()
    return got, total() - before


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


FACES = "face_id int, axis string, sign int, coord double, a double, b double"


def test_facing_walls_shuffle_no_pairs(spark, no_broadcast):
    rows = [(s * 1000 + i * 20 + j, "u", 1 - 2 * s, 1.0 + 4 * s + i / 100, 0.0, 2.0) for s in (0, 1) for i in range(20) for j in range(20)]
    f = spark.createDataFrame(rows, FACES)
    got, moved = shuffled(spark, lambda: sorted((r["lo"], r["hi"], r["width"]) for r in scoring.facing_walls(f, [], digits=2).collect()))
    assert got == sorted((x[0], y[0], round(y[3] - x[3], 2)) for x in rows[:400] for y in rows[400:])
    assert moved < 4 * len(rows)


def test_blocks(spark):
    rows = [(i, "u", 1, 1.0, 0.0, 3.0) for i in range(150)] + [(None, "u", 1, 1.0, 0.0, 3.0)] + [(200 + i, "u", -1, 4.0, 1.0, 9.0) for i in range(70)] + [(300, "u", -1, None, 1.0, 9.0)]
    f = spark.createDataFrame(rows, FACES)
    b = {tuple(r["_ids"]) for r in spatial.blocks(f.filter("sign > 0"), "face_id", ["coord"], 64).collect()}
    assert sorted(map(len, b)) == [23, 64, 64] and {x for ids in b for x in ids} == {*range(150), None}
    got = [tuple(r) for r in scoring.facing_walls(f, []).collect()]
    assert len(got) == 151 * 70 and set(got) == {(x, 200 + y, 3.0) for x in [*range(150), None] for y in range(70)}


RECTS = "room int, u0 double, u1 double, v0 double, v1 double"


def test_overlap_area_shuffles_no_pairs(spark, no_broadcast):
    rows = [(i * 30 + j, i / 100, 3.0, 0.0, 0.9) for i in range(30) for j in range(30)]
    got, moved = shuffled(spark, lambda: sorted(tuple(r) for r in spatial.overlap_area(spark.createDataFrame(rows, RECTS), "room", size=4.0).collect()))
    assert [r[:2] for r in got] == [(a, b) for a in range(900) for b in range(a + 1, 900)]
    assert all(abs(x - 0.9 * (3 - b // 30 / 100)) < 1e-9 for _, b, x in got)
    assert moved < 9 * len(rows)


def test_overlap_area_of_many_copies(spark):
    rows = [(i, 0.0, 1.0, 0.0, 0.7777) for i in range(150)] + [(None, 0.0, 1.0, 0.0, 1.0), (-1, None, 1.0, 0.0, 1.0), (900, 0.5, 1.0, 0.0, 9.0)]
    got = [tuple(r) for r in spatial.overlap_area(spark.createDataFrame(rows, RECTS), "room", digits=2).collect()]
    assert sorted(got) == sorted([(a, b, 0.78) for a in range(150) for b in range(a + 1, 150)] + [(a, 900, 0.39) for a in range(150)])
