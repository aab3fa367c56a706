"""Streams out of order give what the whole tables give in order; state goes; settings come back."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import spatial, windows
from plumbline.queries import REGISTRY
from plumbline.queries import streams as queries
from plumbline.streaming import ordered


@pytest.fixture()
def stream_of(spark, tmp_path):
    """Writes batches of rows as files in turn and runs what is made of the stream; its rows and the last progress."""

    def run(schema, batches, make):
        where = str(tmp_path / f"in-{random.random()}")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        got, stream = [], spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
        q = make(stream).writeStream.foreachBatch(lambda d, i: got.extend(d.collect())).option("checkpointLocation", f"{where}-progress").trigger(availableNow=True).start()
        q.awaitTermination()
        return got, q.recentProgress

    return run


def test_key_frames_in_the_order_of_time(spark, stream_of):
    rng = random.Random(3)
    rows = [(f"c{i % 3}", i, i * 0.1, round(rng.random() * 0.1, 3), round(rng.random(), 3)) for i in range(400)]
    jittered = sorted(rows, key=lambda r: r[2] + rng.random() * 3)
    schema = "capture_id string, frame_id long, t double, shift double, sharpness double"
    batches = [jittered[a : a + 100] for a in range(0, 400, 100)] + [[("end", 9999, 1e5, 0.0, 0.0)], [("late", 10_000, 1.0, 0.0, 0.0), ("c0", 10_001, 2.0, 9.0, 9.0), ("end", 10_002, 2e5, 0.0, 0.0)]]
    make = lambda s: ordered.keyframes(s.withColumn("ts", F.timestamp_micros(((F.col("t") + 1000) * 1e6).cast("long"))).drop("t"), late="5 seconds", expire_s=50.0)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    with ordered.keyed_state(spark):
        got, progress = stream_of(schema, batches, make)
    assert spark.conf.get(setting, None) == before
    want = windows.keyframes(spark.createDataFrame(rows, schema), ["capture_id"], "frame_id", "t", "shift", "sharpness").collect()
    assert sorted(tuple(r) for r in got if r[0] != "end") == sorted(map(tuple, want)) and len(want) > 30
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) > held[-1] and held[-1] <= 12  # the captures' state is gone; what is left is the last one's


def _in_batches(rows, schema, stream_of, spark, n=3, **options):
    """The key frames of rows that come up to 3 s late in n files, those of the whole table, and the most rows of state held."""
    rng = random.Random(5)
    jittered = sorted(rows, key=lambda r: r[2] + rng.random() * 3)
    size = -(-len(rows) // n)
    batches = [jittered[a : a + size] for a in range(0, len(rows), size)] + [[("end", -1, 1e5, 0.0, 0.0)], [("end", -2, 2e5, 0.0, 0.0)]]
    make = lambda s: ordered.keyframes(s.withColumn("ts", F.timestamp_micros(((F.col("t") + 1000) * 1e6).cast("long"))).drop("t"), late="5 seconds", **options)
    with ordered.keyed_state(spark):
        got, progress = stream_of(schema, batches, make)
    want = windows.keyframes(spark.createDataFrame(rows, schema), ["capture_id"], "frame_id", "t", "shift", "sharpness").collect()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    order = lambda x: sorted(x, key=lambda r: (r[0] or "", r[1]))
    return order(tuple(r) for r in got if r[0] != "end"), order(map(tuple, want)), held


def test_state_of_key_frames_grows_by_groups_not_by_captures(spark, stream_of):
    rng = random.Random(6)
    rows = [(f"c{i % 4000}", i, i * 0.001, round(rng.random() * 0.1, 3), round(rng.random(), 3)) for i in range(12_000)]
    got, want, held = _in_batches(rows, "capture_id string, frame_id long, t double, shift double, sharpness double", stream_of, spark)
    assert got == want and len(got) > 4000
    assert max(held) < 4000  # rows of state; with one state a capture they were 8002


@pytest.mark.parametrize("groups", [1, 3])
def test_captures_that_share_a_group(spark, stream_of, groups):
    """Captures that begin, pause and end at their own times, one without a name."""
    rng = random.Random(7)
    rows = [(None if c == 7 else f"c{c}", 2**60 + 1000 * c + i, c * 20.0 + i * 0.4, round(rng.random() * 0.1, 3), round(rng.random(), 3)) for c in range(12) for i in range(40) if (c + i // 10) % 5]
    got, want, held = _in_batches(rows, "capture_id string, frame_id long, t double, shift double, sharpness double", stream_of, spark, n=9, expire_s=30.0, groups=groups)
    assert got == want and len(got) > 60 and any(r[0] is None for r in got)
    assert held[-1] <= 6  # the last one's


def test_a_capture_that_comes_back_after_its_end_begins_anew(spark, stream_of):
    schema = "capture_id string, frame_id long, t double, shift double, sharpness double"
    rows = [("a", i, 0.1 * i, 0.0, 0.5) for i in range(4)] + [("b", 100 + i, 10.0 * i, 0.01, 0.5) for i in range(20)] + [("a", 50, 190.0, 0.0, 0.5), ("a", 51, 190.1, 0.0, 0.9)]
    got, _, _ = _in_batches(rows, schema, stream_of, spark, n=13, expire_s=30.0, groups=1, gap_s=1000.0)
    assert [r for r in got if r[0] == "a"] == [("a", 0), ("a", 50)]


def test_frames_without_a_sharpness_or_a_shift(spark, stream_of):
    """A fold that waits with such frames goes on as that of the whole table does."""
    rows = [(f"c{i % 2}", i, i * 0.2, None if i % 31 == 30 else 0.03, None if i % 5 < 2 else round(i * 7 % 11 / 11, 3)) for i in range(120)]
    got, _, _ = _in_batches(rows, "capture_id string, frame_id long, t double, shift double, sharpness double", stream_of, spark, n=9, groups=1, gap_s=1.0)
    want = []
    for c in ("c0", "c1"):
        last_t, moved, since, last = None, 0.0, 0, []
        for _, f, t, shift, q in (r for r in rows if r[0] == c):
            last = [*last, (float("nan") if q is None else q, f)][-3:]
            moved, since = moved + (float("nan") if shift is None else shift), since + 1
            if last_t is None or (since >= 2 and (moved >= 0.12 or int((t + 1000) * 1e6) / 1e6 - last_t >= 1.0)):
                want.append((c, max(last, key=lambda x: (x[0], -x[1]))[1]))
                last_t, moved, since, last = int((t + 1000) * 1e6) / 1e6, 0.0, 0, []
    assert got == sorted(want) and len(want) > 20


def test_batches_out_of_order_are_whole_and_of_many_files(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "ROWS_A_FILE", 40)
    e, _ = queries._out_of_order(spark, sf)
    batches = []
    e.withColumn("file", F.input_file_name()).writeStream.foreachBatch(lambda d, i: batches.append(d.collect())).trigger(availableNow=True).start().awaitTermination()
    for i, rows in enumerate(batches):
        assert {min(int((r.ts.day + r.event_id % 2) / 11), 2) for r in rows if r.event_id >= 0} == {i}
        each = Counter(r.file for r in rows)
        assert len(each) > 3 and max(each.values()) < len(rows) / 2
    assert len(batches) == 3 and sum(map(len, batches)) == spark.read.parquet(f"{sf}/events.parquet").count() + 2
    for name, of in (("ordered_keyframe_stream", "key_frames"), ("posed_stream", None)):
        got = sorted(map(tuple, REGISTRY[name](spark, sf).collect()))
        monkeypatch.undo()
        assert got == sorted(map(tuple, REGISTRY[of or name](spark, sf).collect()))
        monkeypatch.setattr(queries, "ROWS_A_FILE", 40)


def test_frames_between_poses(spark, stream_of):
    rng = random.Random(4)
    frames = [("f", f"k{i % 2}", i, 10.0 * i + rng.random(), 0.0) for i in range(60)]
    poses = [("p", f"k{i % 2}", i, 7.0 * i + rng.random(), float(i * i % 17)) for i in range(90) if i % 11 > 3]
    rows = sorted(frames + poses, key=lambda r: r[3] + rng.random() * 40)  # up to 40 s late
    end = [("f", "end", -1, 1e6, 0.0), ("p", "end", -1, 1e6, 0.0)]
    schema = "kind string, capture_id string, frame_id long, t double, x double"
    timed = lambda d: d.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))

    def make(s):
        d = timed(s)
        return ordered.between_poses(d.filter("kind = 'f'"), d.filter("kind = 'p'"), "capture_id", "frame_id", "ts", ["x"], reach="1000 seconds", late="60 seconds")

    got, _ = stream_of(schema, [rows[:50], rows[50:100], rows[100:], end], make)
    f, p = (timed(spark.createDataFrame(x, schema)).withColumn("us", F.unix_micros("ts")) for x in (frames, poses))
    want = spatial.asof_interpolated(p.select("capture_id", "us", "x"), f.select("capture_id", "frame_id", "us"), "us", ["x"], ["capture_id"]).collect()
    assert {(r.capture_id, r.frame_id): round(r.x, 6) for r in got} == {(r.capture_id, r.frame_id): round(r.x, 6) for r in want} and len(got) == 60
