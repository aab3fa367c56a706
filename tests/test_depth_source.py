"""The depth capture source: a golden frame, every row filter, pruned spans and columns, files that are missing or broken."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from plumbline.sources import captures, depth_source, png

#: A 3 x 2 image of 16 bits, its rows filtered by average and Paeth, worked out by hand.
GOLDEN = np.array([[1000, 1256, 2], [1001, 65535, 0]], np.uint16)


def reference_filter(image, kinds):
    """Filters an image as the format's text says, byte by byte."""
    h, w = image.shape
    step = image.dtype.itemsize
    raw = image.astype(">u2" if step == 2 else "u1").tobytes()
    width, out = w * step, b""
    at = lambda r, i: raw[r * width + i] if r >= 0 and i >= 0 else 0
    for r in range(h):
        out += bytes([kinds[r]])
        for i in range(width):
            a, b, c = at(r, i - step), at(r - 1, i), at(r - 1, i - step) if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out += bytes([(at(r, i) - [0, a, b, (a + b) // 2, near][kinds[r]]) % 256])
    return out


def as_png(rows, w, h, bits):
    chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    z = zlib.compress(rows)
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, 0, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", z[:5]) + chunk(b"IDAT", z[5:]) + chunk(b"IEND", b"")


def test_golden_frame():
    rows = bytes([3, 3, 232, 3, 116, 254, 142]) + bytes([4, 0, 1, 251, 22, 1, 254])
    assert reference_filter(GOLDEN, [3, 4]) == rows
    assert png.decode(as_png(rows, 3, 2, 16)).tolist() == GOLDEN.tolist()


@pytest.mark.parametrize("bits", [8, 16])
def test_every_filter(bits):
    rng = np.random.default_rng(bits)
    for _ in range(20):
        h, w = int(rng.integers(1, 9)), int(rng.integers(1, 9))
        image = rng.integers(0, 2**bits, (h, w)).astype(f"u{bits // 8}")
        assert png.decode(as_png(reference_filter(image, rng.integers(0, 5, h).tolist()), w, h, bits)).tolist() == image.tolist()
        data = png.encode(image, (0, 1, 2))
        assert png.size_of(data) == (w, h) and png.decode(data).tolist() == image.tolist()


def test_broken_images():
    good = png.encode(GOLDEN)
    for bad in (b"", b"GIF89a" + good[6:], good[:60] + b"x" + good[61:], good[:25] + b"\x02" + good[26:]):
        with pytest.raises((ValueError, struct.error)):
            png.decode(bad)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two captures: flat has 7 frames, hut 3 and no confidence."""
    root = tmp_path_factory.mktemp("captures")
    rows = []
    for name, n in (("flat", 7), ("hut", 3)):
        for i in range(n):
            depth = [float(np.float32((1000 + 10 * i + j) / 1000)) for j in range(6)]
            rows.append((name, i, 3, depth, None if name == "hut" else [j % 3 for j in range(6)], i / 10, 1.0 * i, 2.0, 3.0, 0.0, 0.6, 0.0, 0.8, 30.0, 20.0, 15.0, 10.0))
    d = spark.createDataFrame(rows, "capture_id string, frame_id long, w int, depth array<float>, conf array<byte>, timestamp double, x double, y double, z double, qx double, qy double, qz double, qw double, fx double, fy double, cx double, cy double")
    manifest = depth_source.write_captures(d.repartition(3), str(root)).collect()
    assert {(r.capture_id, r.frames) for r in manifest} == {("flat", 7), ("hut", 3)}
    (root / "notes").mkdir()
    (root / "readme.txt").write_text("no capture")
    depth_source.register(spark)
    return root


def read(spark, folder, **options):
    return spark.read.format("depth_frames").options(**options).load(str(folder))


def test_frames(spark, folder):
    got = {(r.capture_id, r.frame_id): r for r in read(spark, folder, rgb_width=6, rgb_height=4, span=2).collect()}
    assert len(got) == 10
    r = got["flat", 2]
    assert (r.w, r.h, r.ts_s, r.conf) == (3, 2, 0.2, [0, 1, 2, 0, 1, 2]) and np.allclose(r.depth, [1.020, 1.021, 1.022, 1.023, 1.024, 1.025])
    assert (r.fx, r.fy, r.cx, r.cy) == (15.0, 10.0, 7.5, 5.0)
    turn = np.array(r.t_wc).reshape(4, 4)
    assert np.allclose(turn, [[0.28, 0, 0.96, 2], [0, 1, 0, 2], [-0.96, 0, 0.28, 3], [0, 0, 0, 1]])
    assert got["hut", 0].conf is None
    # the same pose as the columns that expressions make
    odo = captures.poses(captures.odometry(spark, str(folder / "flat"))).filter("frame = 2").first()
    assert np.allclose([odo[f"r{i}{j}"] for i in range(3) for j in range(3)], turn[:3, :3].ravel())


def test_one_capture_alone(spark, folder):
    assert read(spark, folder / "hut").select("capture_id").distinct().collect() == [("hut",)]


def test_filters_and_columns_reach_the_source(spark, folder):
    reader = depth_source.DepthReader(captures.FRAMES, {"path": str(folder), "span": "2"})
    assert len(reader.partitions()) == 4 + 2
    left = list(reader.pushFilters([EqualTo(("capture_id",), "flat"), GreaterThan(("frame_id",), 1), LessThanOrEqual(("frame_id",), 4), StringStartsWith(("capture_id",), "f"), EqualTo(("w",), 3)]))
    assert [type(f).__name__ for f in left] == ["StringStartsWith", "EqualTo"]
    assert [(p.capture_id, p.start) for p in reader.partitions()] == [("flat", 2), ("flat", 4)]
    reader = depth_source.DepthReader(captures.FRAMES, {"path": str(folder), "span": "2"})
    assert list(reader.pushFilters([In(("frame_id",), (0, 6)), In(("capture_id",), ("flat", "none"))])) == []
    assert [(p.capture_id, p.start) for p in reader.partitions()] == [("flat", 0), ("flat", 6)]
    d = read(spark, folder, span=2).filter("capture_id = 'flat' AND frame_id > 1 AND frame_id <= 4")
    assert sorted(r.frame_id for r in d.select("frame_id").collect()) == [2, 3, 4]
    assert d.rdd.getNumPartitions() == 2
    # without image columns no image is opened: a broken one doesn't matter
    import shutil

    broken = folder.parent / "broken"
    shutil.copytree(folder, broken, dirs_exist_ok=True)
    (broken / "flat" / "depth" / "000003.png").write_bytes(b"not an image")
    few = spark.read.format("depth_frames").schema("capture_id string, frame_id long, fx double").load(str(broken))
    assert few.count() == 10 and few.agg(F.sum("fx")).first()[0] == 300.0
    with pytest.raises(Exception, match="000003.png: not a PNG image"):
        read(spark, broken).collect()
    assert read(spark, broken).filter("frame_id = 2").count() == 2
    with pytest.raises(Exception, match="have no columns"):
        spark.read.format("depth_frames").schema("capture_id string, colour int").load(str(broken)).collect()


def test_uneven_and_empty_folders(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder / "flat", tmp_path / "a" / "flat")
    (tmp_path / "a" / "flat" / "depth" / "000006.png").unlink()
    assert read(spark, tmp_path / "a").count() == 6  # the lesser of images and odometry rows
    lines = (tmp_path / "a" / "flat" / "odometry.csv").read_text().splitlines()
    (tmp_path / "a" / "flat" / "odometry.csv").write_text("\n".join(lines[:5]))
    assert read(spark, tmp_path / "a", span=3).count() == 4
    (tmp_path / "b").mkdir()
    assert read(spark, tmp_path / "b").count() == 0 and read(spark, tmp_path / "b").schema == captures.FRAMES
