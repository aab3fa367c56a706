"""Row-wise geometry of cameras, plans and tiles, views of tiles, lifted boxes and dense pairs, each against SQL that says it another way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.intervals95 import area_ci
from ..operators import damage, frames, robust, spatial
from . import depth, query, table


def _d(c: Column) -> Column:
    return c.cast("double")


@query(
    """WITH p AS (SELECT o_orderkey, (o_orderkey % 101 / 10.0)::DOUBLE AS x, (o_custkey % 77 / 7.0)::DOUBLE AS z, (o_orderkey % 13 / 13.0)::DOUBLE AS yaw FROM orders)
SELECT o_orderkey, round(sqrt(x * x + z * z) * cos(atan2(z, x) - yaw), 6) + 0 AS u, round(sqrt(x * x + z * z) * sin(atan2(z, x) - yaw), 6) + 0 AS v, round(x, 6) + 0 AS x, round(z, 6) + 0 AS z FROM p"""
)
def plan_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World to plan and back: a turn by minus the yaw."""
    k = F.col("o_orderkey")
    x, z, yaw = _d(k % 101 / 10), _d(F.col("o_custkey") % 77 / 7), _d(k % 13 / 13)
    u, v = G.rotate_plan(x, z, yaw)
    back = G.unrotate_plan(u, v, yaw)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[(F.round(c, 6) + 0.0).alias(n) for n, c in (("u", u), ("v", v), ("x", back[0]), ("z", back[1]))])


@query(
    """WITH p AS (SELECT p_partkey, 1000 + p_partkey % 1200 AS w, 700 + p_partkey * 7 % 900 AS h, 20 + p_size % 20 AS f35, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 'infinity'::DOUBLE WHEN p_partkey % 10 = 2 THEN 'nan'::DOUBLE ELSE p_size / 7.0::DOUBLE END AS d FROM part)
SELECT p_partkey, round(f35 * sqrt(w * w + h * h) / 43.2666, 4) AS focal, (round_even(w * 0.5 / 14, 0) * 14)::INTEGER AS model_w, CASE WHEN 3 * w > 4 * h THEN round_even(h * 4.0::DOUBLE / 3, 0) ELSE w END::INTEGER AS crop_w,
  CASE WHEN 3 * w > 4 * h THEN h ELSE round_even(w / (4.0::DOUBLE / 3), 0) END::INTEGER AS crop_h, round(CASE WHEN d IS NULL OR NOT isfinite(d) THEN 0 ELSE d / 0.955 END, 6)::DOUBLE AS depth FROM p"""
)
def photo_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focal lengths from their 35-mm equivalents, crops, model sizes, calibrated depths."""
    k = F.col("p_partkey")
    w, h = 1000 + k % 1200, 700 + k * 7 % 900
    d = F.when(k % 10 == 0, None).when(k % 10 == 1, float("inf")).when(k % 10 == 2, float("nan")).otherwise(F.col("p_size") / 7.0)
    crop = G.crop_to_aspect(w, h, 4 / 3)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.focal_from_f35(20 + F.col("p_size") % 20, w, h), 4).alias("focal"), G.model_size(w, F.lit(0.5), 14).alias("model_w"), crop[0].alias("crop_w"), crop[1].alias("crop_h"), F.round(G.calibrated_depth(d), 6).alias("depth"))


@query(
    """WITH v AS (SELECT event_id, (event_id % 9 - 4)::DOUBLE AS x, (event_id % 5 - 2)::DOUBLE AS y, (event_id % 7 + 1)::DOUBLE AS z, (event_id % 3)::DOUBLE AS a, (event_id % 4 - 1)::DOUBLE AS b FROM events),
c AS (SELECT *, sqrt(x * x + y * y + z * z) AS d, sqrt(a * a + b * b + 1) AS n FROM v) SELECT event_id, round(abs(x * a + y * b + z) / (d * n) / (CASE WHEN d < 0.3 THEN 0.3 ELSE d END), 8) AS score,
  round(0.16 * abs(x * a + y * b + z) / (d * n) * 500 * 480 / (d * d), 4) AS pixels, round(atan2(x, z) * 180 / pi(), 6) AS heading, round(asin(y / d), 8) AS pitch FROM c"""
)
def view_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a surface is seen from a camera, how many pixels a tile would fill, and where the camera looks."""
    k = F.col("event_id")
    p = tuple(_d(c) for c in (k % 9 - 4, k % 5 - 2, k % 7 + 1))
    a, b = _d(k % 3), _d(k % 4 - 1)
    size = F.sqrt(a * a + b * b + 1)
    cosine, d = G.view_cosine(p, (a / size, b / size, 1 / size)), G.norm(p)
    return table(spark, sf_dir, "events").select("event_id", F.round(G.view_score(cosine, d), 8).alias("score"), F.round(G.expected_pixels(0.4, cosine, d, F.lit(500.0), F.lit(480.0)), 4).alias("pixels"), F.round(G.heading(p[0], p[2]), 6).alias("heading"), F.round(G.pitch(*p), 8).alias("pitch"))


@query(
    """WITH u AS (SELECT event_id, (event_id % 9 - 4)::DOUBLE AS a, (event_id % 11 - 3)::DOUBLE AS b, (event_id % 7 - 3)::DOUBLE AS c FROM events WHERE NOT (event_id % 9 = 4 AND event_id % 7 = 3)),
n AS (SELECT event_id, a / sqrt(a*a + b*b + c*c) AS x, b / sqrt(a*a + b*b + c*c) AS y, c / sqrt(a*a + b*b + c*c) AS z FROM u),
r AS (SELECT * FROM n WHERE y > -0.99)
SELECT event_id, round(1 - x * 2 + (-x * x * 1 - x * z * 3) / (1 + y), 6) + 0 AS px, round(1 * x + 2 * y + 3 * z, 6) + 0 AS py, round(3 - z * 2 + (-z * z * 3 - x * z * 1) / (1 + y), 6) + 0 AS pz FROM r"""
)
def upright_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point (1, 2, 3) after the turn that takes a direction to +y: v x p + v x (v x p) / (1 + y) on top of it, v the axis times the sine."""
    k = F.col("event_id")
    a = tuple(_d(c) for c in (k % 9 - 4, k % 11 - 3, k % 7 - 3))
    up = tuple(c / G.norm(a) for c in a)
    e = table(spark, sf_dir, "events").filter(~((k % 9 == 4) & (k % 7 == 3))).filter(up[1] > -0.99)
    p = G.to_world(tuple(F.lit(x) for x in (1.0, 2.0, 3.0)), G.axis_rotation(up))
    return e.select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(p, ("px", "py", "pz"), strict=True)])


@query(
    """WITH p AS (SELECT p_partkey, 100 + p_partkey % 300 AS w, 80 + p_partkey * 3 % 200 AS h FROM part), s AS (SELECT *, unnest([1.0, 0.5, 0.25]) AS scale FROM p), z AS (SELECT *, floor(least(w, h) * scale)::BIGINT AS size FROM s),
t AS (SELECT *, greatest(size // 2, 1) AS step FROM z), x AS (SELECT *, unnest(range(0, w - size + 1, step)) AS x FROM t), y AS (SELECT *, unnest(range(0, h - size + 1, step)) AS y FROM x) SELECT p_partkey, count(*) AS tiles, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys, sum(size)::BIGINT AS sizes FROM y GROUP BY 1"""
)
def photo_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of images at three scales with half overlap."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select("p_partkey", F.explode(G.image_tiles(100 + k % 300, 80 + k * 3 % 200)).alias("t"))
    return t.groupBy("p_partkey").agg(F.count("*").alias("tiles"), F.sum("t.x").alias("xs"), F.sum("t.y").alias("ys"), F.sum("t.size").alias("sizes"))


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 2 = 0 THEN 'u' ELSE 'v' END AS axis, (l_quantity / 10)::DOUBLE AS coord, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END AS sign, l_linenumber % 4 AS k FROM lineitem),
p AS (SELECT *, CASE WHEN axis = 'u' THEN coord ELSE 0 END AS x, CASE WHEN axis = 'v' THEN coord ELSE 0 END AS y, CASE WHEN axis = 'u' THEN sign ELSE 0 END AS nx, CASE WHEN axis = 'v' THEN sign ELSE 0 END AS ny FROM f),
t AS (SELECT *, CASE k WHEN 0 THEN nx WHEN 1 THEN -ny WHEN 2 THEN -nx ELSE ny END AS mx, CASE k WHEN 0 THEN ny WHEN 1 THEN nx WHEN 2 THEN -ny ELSE -nx END AS my, CASE k WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END AS tx, CASE k WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END AS ty FROM p)
SELECT CASE WHEN mx <> 0 THEN 'u' ELSE 'v' END AS axis, (mx + my)::INTEGER AS sign, k::INTEGER AS k, count(*) AS n, round(sum(tx + ty), 4) AS coord FROM t GROUP BY ALL"""
)
def turned_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces after quarter turns; the SQL turns their normals and foot points."""
    axis, sign = F.when(F.col("l_partkey") % 2 == 0, "u").otherwise("v"), F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1)
    k = (F.col("l_linenumber") % 4).cast("int")
    a, c, s = G.quarter_turn(axis, F.col("l_quantity") / 10, sign, k)
    d = table(spark, sf_dir, "lineitem").select(a.alias("axis"), s.alias("sign"), k.alias("k"), c.alias("c"))
    return d.groupBy("axis", "sign", "k").agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("coord"))


_DENSE = """p AS (SELECT 'c' || (l_suppkey % 25) AS capture_id, l_orderkey // 8000 AS frame_id, (l_partkey % 12) AS r, (l_orderkey % 16) AS c, max((500 + l_quantity * 50 + l_linenumber)::INTEGER) AS mm FROM lineitem GROUP BY ALL),
g AS (SELECT capture_id, frame_id, r, c, coalesce(mm, 0) / 1000.0::DOUBLE AS d FROM (SELECT capture_id, frame_id, r, c FROM (SELECT DISTINCT capture_id, frame_id FROM p), range(12) a(r), range(16) b(c)) LEFT JOIN p USING (capture_id, frame_id, r, c))"""


@query(
    f"""WITH {_DENSE}, q AS (SELECT *, (c - 8) * d / 16 AS x, (r - 6) * d / 16 AS y FROM g),
n AS (SELECT m.capture_id, m.frame_id, m.d, m.x, m.y, e.x - w.x AS hx, e.y - w.y AS hy, e.d - w.d AS hz, s.x - t.x AS vx, s.y - t.y AS vy, s.d - t.d AS vz FROM q m JOIN q e ON e.capture_id = m.capture_id AND e.frame_id = m.frame_id AND e.r = m.r AND e.c = m.c + 1 JOIN q w ON w.capture_id = m.capture_id AND w.frame_id = m.frame_id AND w.r = m.r AND w.c = m.c - 1
  JOIN q s ON s.capture_id = m.capture_id AND s.frame_id = m.frame_id AND s.r = m.r + 1 AND s.c = m.c JOIN q t ON t.capture_id = m.capture_id AND t.frame_id = m.frame_id AND t.r = m.r - 1 AND t.c = m.c),
k AS (SELECT *, hy * vz - hz * vy AS a, hz * vx - hx * vz AS b, hx * vy - hy * vx AS e FROM n), o AS (SELECT *, sqrt(a * a + b * b + e * e) AS size, CASE WHEN a * x + b * y + e * d > 0 THEN -1 ELSE 1 END AS way FROM k)
SELECT capture_id, frame_id, count(*) AS n, round(sum(way * a / size), 4) AS nx, round(sum(way * b / size), 4) AS ny, round(sum(way * e / size), 4) AS nz FROM o WHERE d > 0.15 AND d < 4 AND size > 0 AND greatest(abs(hz), abs(vz)) < 0.08 * d + 0.6 GROUP BY ALL"""
)
def pixel_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals of the depth frames' pixels by central differences, facing the camera, where depth doesn't jump."""
    f = depth.frames_of(spark, sf_dir).select("capture_id", "frame_id", F.posexplode(F.transform("depth", lambda x: F.round(x * 1000) / 1000)).alias("i", "depth"))
    i = F.col("i")
    px = f.select("capture_id", "frame_id", F.floor(i / 16).cast("int").alias("row"), (i % 16).cast("int").alias("col"), "depth", F.lit(2).alias("conf"), *[F.lit(v).alias(n) for n, v in (("fx", 16.0), ("fy", 16.0), ("cx", 8.0), ("cy", 6.0))])
    n = frames.normals(frames.camera_points(px), jump=0.6)  # these frames are rough
    return n.groupBy("capture_id", "frame_id").agg(F.count("*").alias("n"), *[F.round(F.sum(f"cn{a}"), 4).alias(f"n{a}") for a in "xyz"])


@query(
    """WITH x AS (SELECT l_orderkey % 7 AS frame, l_suppkey % 100 AS tile, 2 + l_partkey % 90 AS x, 2 + l_orderkey * 7 % 90 AS y, 0.5 + l_quantity / 25.0::DOUBLE AS d, 0.2 + l_linenumber / 10.0::DOUBLE AS cosine FROM lineitem),
v AS (SELECT frame, tile, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, median(d) AS d, median(cosine) AS cosine, count(*) AS n FROM x GROUP BY ALL) SELECT frame, tile, n, round(cosine / greatest(d, 0.3), 6) AS score FROM v
WHERE x0 > 1 AND y0 > 1 AND x1 < 98 AND y1 < 98 AND least(x1 - x0, y1 - y0) + 1 >= 64 AND d <= 3 AND n >= 0.5 * 0.16 * cosine * 60 * 60 / (d * d)"""
)
def tile_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tiles are views of a surface: large, whole, near and half full."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("frame"), (F.col("l_suppkey") % 100).alias("tile"), (2 + F.col("l_partkey") % 90).alias("x"), (2 + F.col("l_orderkey") * 7 % 90).alias("y"), (0.5 + F.col("l_quantity") / 25).alias("d"), (0.2 + F.col("l_linenumber") / 10).alias("cos"), *[F.lit(v).alias(n) for n, v in (("fx", 60.0), ("fy", 60.0), ("width", 100), ("height", 100))])
    return damage.tile_views(d, ["tile"], []).select("frame", "tile", "n", F.round("score", 6).alias("score"))


@query(
    """WITH x AS (SELECT l_suppkey % 20 AS frame, l_partkey % 200 AS x, l_orderkey % 150 AS y, l_quantity / 10.0::DOUBLE AS depth FROM lineitem), b AS (SELECT p_partkey AS box, p_partkey % 20 AS frame, p_partkey * 7 % 150 AS x0, p_partkey * 13 % 100 AS y0 FROM part),
j AS (SELECT box, depth FROM b JOIN x ON x.frame = b.frame AND abs(x - (x0 + 20)) <= 8 AND abs(y - (y0 + 15)) <= 6 AND depth > 0.1) SELECT box, round(median(depth), 6) AS depth, count(*) AS pixels FROM j GROUP BY box HAVING count(*) >= 3 AND median(depth) <= 4.5"""
)
def lifted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth of detections: the median of the inner part of their boxes."""
    px = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("frame"), (F.col("l_partkey") % 200).alias("x"), (F.col("l_orderkey") % 150).alias("y"), (F.col("l_quantity") / 10).alias("depth"))
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select(k.alias("box"), (k % 20).alias("frame"), (k * 7 % 150).alias("x0"), (k * 13 % 100).alias("y0"), (k * 7 % 150 + 40).alias("x1"), (k * 13 % 100 + 30).alias("y1"))
    return spatial.lifted_detections(px, b, ["frame"], "box").select("box", F.round("depth", 6).alias("depth"), "pixels")


@query(
    """WITH r AS (SELECT l_suppkey % 30 AS view, l_partkey AS pixel, l_linenumber % 2 AS run, max(l_quantity) AS conf FROM lineitem GROUP BY ALL), q AS (SELECT run, view, quantile_cont(conf, 0.4) AS p40 FROM r GROUP BY ALL), s AS (SELECT r.* FROM r JOIN q USING (run, view) WHERE conf >= p40)
SELECT a.view, count(*) AS pairs, sum(a.conf + b.conf)::BIGINT AS conf FROM s a JOIN s b ON a.view = b.view AND a.pixel = b.pixel AND a.run = 0 AND b.run = 1 GROUP BY 1"""
)
def dense_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that two runs over the same views are both sure of."""
    r = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 30).alias("view"), F.col("l_partkey").alias("pixel"), (F.col("l_linenumber") % 2).alias("run")).agg(F.max("l_quantity").alias("conf"))
    sure = lambda k: robust.confidence_levels(r.filter(F.col("run") == k), "conf", "view", 1).filter("level = 2").select("view", "pixel", F.col("conf").alias(f"c{k}"))
    return sure(0).join(sure(1), ["view", "pixel"]).groupBy("view").agg(F.count("*").alias("pairs"), F.sum(F.col("c0") + F.col("c1")).cast("long").alias("conf"))


@query("WITH r AS (SELECT p_partkey, 2 + p_size / 10.0::DOUBLE AS u, 1 + p_partkey % 40 / 10.0::DOUBLE AS v, 0.01 + p_size / 1000.0::DOUBLE AS cu, 0.01 + p_partkey % 7 / 500.0::DOUBLE AS cv FROM part) SELECT p_partkey, round(sqrt(cu * v * cu * v + cv * u * cv * u), 8) AS ci95 FROM r")
def area_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of areas from those of their sides."""
    k, s = F.col("p_partkey"), F.col("p_size")
    u, v, cu, cv = 2 + s / 10, 1 + k % 40 / 10, 0.01 + s / 1000, 0.01 + k % 7 / 500
    return table(spark, sf_dir, "part").select("p_partkey", F.round(area_ci(u * v, u, cu, v, cv), 8).alias("ci95"))
