"""Queries for parts of plans: the known room's openings, ceilings, features and bands; grids, seeds, views, samples and joins of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.intervals95 import LIDAR, PHOTO, opening_ci
from ..operators import damage, frames, graph, plan2d, raster, register, rooms
from ..plans.capture import instances, plan_capture
from ..plans.known_room import POINTS_SQL, points_m, points_mm
from ..plans.photo import global_ceiling
from ..sources import captures
from . import query, table
from .rasters import OTHER, SPARSE, other_cells, sparse

P = f"WITH {POINTS_SQL}"
_FACES = "f AS (SELECT round(avg(u_mm) FILTER (WHERE s = 2) / 1000.0, 2) AS u0, round(avg(u_mm) FILTER (WHERE s = 6) / 1000.0, 2) AS um, round(avg(u_mm) FILTER (WHERE s = 3) / 1000.0, 2) AS u1, round(avg(v_mm) FILTER (WHERE s = 0) / 1000.0, 2) AS v0, round(avg(v_mm) FILTER (WHERE s = 1) / 1000.0, 2) AS v1 FROM points)"


#: What the partition's points leave open, and the sides of it that have a floor, numbered from the least u.
_DOOR = """w AS (SELECT DISTINCT v_mm FROM points WHERE s = 6), g AS (SELECT v_mm AS a, lead(v_mm) OVER (ORDER BY v_mm) AS b FROM w), d AS (SELECT a / 1000.0::DOUBLE AS a, b / 1000.0::DOUBLE AS b FROM g WHERE b - a BETWEEN 550 AND 1300),
x AS (SELECT avg(u_mm) / 1000.0::DOUBLE AS um FROM points WHERE s = 6), side AS (SELECT side, row_number() OVER (ORDER BY min(u_mm))::INTEGER AS room FROM (SELECT u_mm, u_mm / 1000.0::DOUBLE > um AS side FROM points, x WHERE s = 4) GROUP BY side)"""


@query(P + f""", {_DOOR} SELECT min(room) AS room_a, max(room) AS room_b, CASE WHEN any_value(b - a) <= 1.3 THEN 'door' ELSE 'opening' END AS kind, 'u' AS axis, round(any_value(um), 2) AS coord, round(any_value(a) * 10) / 10 AS a, round(any_value(b) * 10) / 10 AS b, round(any_value(b - a) * 10) / 10 AS width,
round(1.96 * sqrt(2 * 0.008::DOUBLE * 0.008::DOUBLE), 4) AS ci95 FROM d, x, side GROUP BY d.a""")
def plan_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known room's one door, to the half decimetre of its wall columns."""
    o = plan_capture(points_m(spark, sf_dir), ["capture_id"], cover=0.30).openings
    near = lambda c: (F.round(F.col(c) * 10) / 10).alias(c)
    return o.select("room_a", "room_b", "kind", "axis", F.round("coord", 2).alias("coord"), near("a"), near("b"), (F.round(F.col("width.value") * 10) / 10).alias("width"), F.col("width.ci95").alias("ci95"))


@query(
    P + f""", {_FACES}, c AS (SELECT CASE WHEN u_mm < 2500 THEN 1 ELSE 2 END AS room, h_mm / 1000.0::DOUBLE AS h FROM points WHERE s = 5), fl AS (SELECT sqrt((3 * stddev_pop(h_mm / 1000.0::DOUBLE) / sqrt(count(*))) ** 2 + 0.004 ** 2) AS sf FROM points WHERE s = 4)
SELECT room, round(avg(h), 3) AS ceiling, round(1.96 * sqrt((3 * stddev_pop(h) / sqrt(count(*))) ** 2 + 0.006 ** 2 + any_value(sf) ** 2), 3) AS ci95 FROM c, fl GROUP BY room"""
)
def plan_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = plan_capture(points_m(spark, sf_dir), ["capture_id"], cover=0.30).ceilings
    return c.select("room", F.round("ceiling", 3).alias("ceiling"), F.round("ci95", 3).alias("ci95"))


@query(
    P + f""", {_FACES}, {_DOOR}, r AS (SELECT room, CASE WHEN side THEN u1 - f.um ELSE f.um - u0 END AS w, v1 - v0 AS h FROM f, side), o AS (SELECT count(*) AS n FROM d), z AS (SELECT count(*) FILTER (WHERE nh = 1 AND h_mm < -120) AS n FROM points)
SELECT room, round(w * h, 1) AS area, round(greatest(w, h), 2) AS long_side, round(least(w, h), 2) AS short_side, (SELECT n FROM o) AS n_openings, (SELECT least(n, 1) FROM o) AS degree, (SELECT n FROM z) AS below_points, CASE WHEN least(w, h) < 1.6 AND greatest(w, h) >= 2 * least(w, h) THEN 'Corridor' ELSE 'Room' END AS type, round((SELECT sum(w * h) FROM r), 1) AS footprint FROM r"""
)
def plan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan_capture(points_m(spark, sf_dir), ["capture_id"], cover=0.30)
    f = p.features.join(p.types.select("capture_id", "room", "type"), ["capture_id", "room"]).join(p.footprint, "capture_id")
    return f.select("room", F.round("area", 1).alias("area"), F.round("long_side", 2).alias("long_side"), F.round("short_side", 2).alias("short_side"), "n_openings", "degree", "below_points", "type", F.round("footprint", 1).alias("footprint"))


@query(
    P + """, x AS (SELECT frame_id % 2 AS k, h_mm / CASE WHEN frame_id % 2 = 0 THEN 1000.0::DOUBLE ELSE 500.0::DOUBLE END AS h, nh, nu, nv FROM points), t AS (SELECT k, quantile_cont(h, 0.97) AS top FROM x WHERE nh = 0 AND h > 0.1 GROUP BY k),
d AS (SELECT k, h FROM x WHERE nh = -1 AND h > 1.8), c AS (SELECT k, avg(h) AS ceiling, count(*) AS n FROM d GROUP BY k)
SELECT t.k, 0.25::DOUBLE AS band_lo, round(least(top, CASE WHEN n >= 100 THEN ceiling - 0.15 ELSE 9 END, 9), 4) AS band_hi FROM t JOIN c USING (k)"""
)
def height_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures, one twice as high as the other: each has its own band."""
    p = points_mm(spark, sf_dir).select((F.col("frame_id") % 2).alias("k"), (F.col("h_mm") / F.when(F.col("frame_id") % 2 == 0, 1000.0).otherwise(500.0)).alias("h"), F.col("nh").alias("ny"))
    b = plan2d.height_bands(p, ["k"], enough=100)
    return b.select("k", "band_lo", F.round("band_hi", 4).alias("band_hi"))


@query(P + " SELECT s, min(u_mm) - 50.0::DOUBLE AS u0, min(v_mm) - 50.0::DOUBLE AS v0, (ceil((max(u_mm) - min(u_mm) + 100) / 20.0) + 1)::INTEGER AS nu, (ceil((max(v_mm) - min(v_mm) + 100) / 20.0) + 1)::INTEGER AS nv FROM points GROUP BY s")
def grid_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raster.extent(points_mm(spark, sf_dir), "u_mm", "v_mm", 20.0, 50.0, ["s"])
    return e.select("s", F.col("u0").cast("double").alias("u0"), F.col("v0").cast("double").alias("v0"), "nu", "nv")


@query("SELECT l_orderkey, l_linenumber, least(greatest(floor((l_quantity - 5) / 4.0), 0), 9)::BIGINT AS bin FROM lineitem")
def height_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.height_bin(F.col("l_quantity"), 5.0, 4.0, 10).cast("long").alias("bin"))


@query("SELECT o_orderkey, round(0.5 * (0.8 * x - 0.6 * z) + 1, 6) AS x, round(0.5 * y - 2, 6) AS y, round(0.5 * (0.6 * x + 0.8 * z) + 3, 6) AS z FROM (SELECT o_orderkey, (o_orderkey % 100)::DOUBLE AS x, (o_custkey % 90)::DOUBLE AS y, (o_orderkey % 70)::DOUBLE AS z FROM orders)")
def similar_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sim(3): half the scale, turned about y, moved."""
    o = table(spark, sf_dir, "orders")
    p = tuple(c.cast("double") for c in (F.col("o_orderkey") % 100, F.col("o_custkey") % 90, F.col("o_orderkey") % 70))
    turn = {"r00": 0.8, "r02": -0.6, "r11": 1.0, "r20": 0.6, "r22": 0.8}
    rotation = {f"r{i}{j}": F.lit(turn.get(f"r{i}{j}", 0.0)) for i in range(3) for j in range(3)}
    s = G.similarity(p, F.lit(0.5), rotation, (F.lit(1.0), F.lit(-2.0), F.lit(3.0)))
    return o.select("o_orderkey", *[F.round(c, 6).alias(n) for n, c in zip("xyz", s, strict=True)])


@query("SELECT p_partkey, round(p_size * 10 * 0.25, 6)::DOUBLE AS fx, round(p_size * 11 * (5.0 / 16), 6)::DOUBLE AS fy, round(p_size * 4 * 0.25, 6)::DOUBLE AS cx, round(p_size * 3 * (5.0 / 16), 6)::DOUBLE AS cy FROM part")
def rescaled_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    k = G.rescaled_intrinsics(s * 10, s * 11, s * 4, s * 3, (1024, 768), (256, 240))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 6).alias(n) for n, c in zip(("fx", "fy", "cx", "cy"), k, strict=True)])


_REGIONS = "w(k, x, y) AS (SELECT k, r * 1048576 + c, r * 1048576 + c FROM c UNION SELECT w.k, w.x, n.y FROM w JOIN n ON n.k = w.k AND n.x = w.y), m AS (SELECT k, x // 1048576 AS r, x % 1048576 AS c, min(y) AS component FROM w GROUP BY k, x)"
_NEAR = "n AS (SELECT a.k, a.r * 1048576 + a.c AS x, b.r * 1048576 + b.c AS y FROM c a CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) s(i, j) JOIN c b ON a.k = b.k AND b.r = a.r + i AND b.c = a.c + j)"


@query(f"WITH RECURSIVE {SPARSE}, {OTHER}, {_NEAR}, {_REGIONS}, q AS (SELECT k, component FROM m SEMI JOIN o ON o.k = m.k AND o.r = m.r AND o.c = m.c GROUP BY ALL HAVING count(*) >= 2) SELECT m.* FROM m SEMI JOIN q ON q.k = m.k AND q.component = m.component")
def seeded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = graph.cell_components(sparse(spark, sf_dir), "r", "c", ["k"], diagonal=False).select("k", "r", "c", "component")
    return raster.seeded(comp, other_cells(spark, sf_dir), ["k"], 2)


@query(f"WITH RECURSIVE {SPARSE}, {_NEAR}, {_REGIONS}, g AS (SELECT k, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM c GROUP BY k), t AS (SELECT DISTINCT m.k, m.component FROM m JOIN g ON g.k = m.k WHERE r <= r0 OR r >= r1 OR c <= c0 OR c >= c1) SELECT m.* FROM m ANTI JOIN t ON t.k = m.k AND t.component = m.component")
def inner_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that don't touch the border of their raster."""
    cells = sparse(spark, sf_dir)
    comp = graph.cell_components(cells, "r", "c", ["k"], diagonal=False).select("k", "r", "c", "component")
    box = cells.groupBy("k").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return raster.off_border(comp, box, ["k"])


@query("SELECT l_orderkey, l_linenumber, (l_partkey / 2)::INTEGER AS row, (l_suppkey / 2)::INTEGER AS col, round(l_quantity / 2.0, 6)::DOUBLE AS fx FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 2 = 0 AND l_linenumber % 3 > 0")
def half_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views keep every other row and column of the pixels with confidence."""
    q = F.col("l_quantity").cast("double")
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), (F.col("l_linenumber") % 3).alias("level"), *[q.alias(c) for c in ("fx", "fy", "cx", "cy")])
    return frames.half_resolution(p).select("l_orderkey", "l_linenumber", "row", "col", F.round("fx", 6).alias("fx"))


@query("SELECT l_orderkey AS frame_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def wanted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a list that repeats numbers."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("frame_id"))
    return captures.wanted_frames(f, o.unionAll(o))


@query("WITH m AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), v AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer) SELECT 'meta' AS side, count(*) AS n FROM m SEMI JOIN v ON v.k = m.k UNION ALL SELECT 'views', count(*) FROM v SEMI JOIN m ON m.k = v.k")
def reconciled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    a, b = captures.reconciled(m, v, ["k"])
    n = lambda d, side: d.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a, "meta").unionByName(n(b, "views"))


@query("SELECT c_nationkey AS k, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS room FROM customer GROUP BY 1")
def largest_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("room"), F.col("c_acctbal").alias("area"))
    return rooms.largest(c, ["k"])


@query("SELECT c_nationkey AS capture_id, median(c_acctbal::DOUBLE) AS ceiling, count(c_acctbal) AS rooms FROM customer GROUP BY 1")
def global_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_ceiling(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("capture_id"), F.col("c_acctbal").cast("double").alias("ceiling")))


@query("SELECT p_partkey AS room, p_partkey % 10 - 0.2::DOUBLE AS u0, p_partkey % 10 + 1 + 0.2::DOUBLE AS u1, p_size - 0.2::DOUBLE AS v0, p_size + 2 + 0.2::DOUBLE AS v1 FROM part")
def wall_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    r = table(spark, sf_dir, "part").select(k.alias("room"), (k % 10).cast("double").alias("u0"), (k % 10 + 1).cast("double").alias("u1"), s.alias("v0"), (s + 2).alias("v1"))
    return plan2d.wall_solids(r, [])


@query(
    """WITH t AS (SELECT o_custkey AS image, o_orderkey % 20 AS x0, o_orderkey * 7 % 20 AS y0, 2 + o_orderkey % 3 AS size, CASE o_orderkey % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'crack' WHEN 2 THEN 'mould' ELSE 'stain' END AS class, (o_orderkey % 8) / 8.0::DOUBLE AS p FROM orders),
c AS (SELECT *, unnest(range(y0, y0 + size)) AS y FROM (SELECT *, unnest(range(x0, x0 + size)) AS x FROM t)), n AS (SELECT image, x, y, count(*) AS n, count(*) FILTER (WHERE class <> 'plain') AS bad FROM c GROUP BY ALL), s AS (SELECT image, x, y, class, sum(p) AS s FROM c WHERE class <> 'plain' GROUP BY ALL), b AS (SELECT image, x, y, arg_max(class, (s, class)) AS class FROM s GROUP BY ALL)
SELECT image, x, y, b.class FROM n JOIN b USING (image, x, y) WHERE bad >= 0.5 * n.n"""
)
def pixel_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "plain").when(k % 4 == 1, "crack").when(k % 4 == 2, "mould").otherwise("stain")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), (k % 20).alias("x0"), (k * 7 % 20).alias("y0"), (2 + k % 3).alias("size"), kind.alias("class"), (k % 8 / 8.0).cast("double").alias("p"))
    return damage.pixel_votes(t, ["image"])


@query("WITH o AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'door' WHEN 1 THEN 'window' ELSE 'opening' END AS kind, p_size / 10.0::DOUBLE AS w FROM part), e AS (SELECT *, CASE kind WHEN 'door' THEN 2 * 0.008 ** 2 WHEN 'window' THEN 0.02 ** 2 ELSE 2 * 0.03 ** 2 END AS l, CASE kind WHEN 'window' THEN 0.02 ** 2 ELSE 2 * 0.03 ** 2 END AS p FROM o) SELECT id, round(1.96 * sqrt(l), 6) AS lidar, round(1.96 * sqrt(p + (0.12 * w) ** 2), 6) AS photo FROM e")
def opening_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, w = F.col("p_partkey"), F.col("p_size") / 10.0
    kind = F.when(k % 3 == 0, "door").when(k % 3 == 1, "window").otherwise("opening")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(opening_ci(kind, w, LIDAR), 6).alias("lidar"), F.round(opening_ci(kind, w, PHOTO), 6).alias("photo"))


@query(
    """WITH d AS (SELECT o_orderkey % 5 AS k, o_custkey % 60 AS spot, CASE o_custkey % 3 WHEN 0 THEN 'toilet' WHEN 1 THEN 'sink' ELSE 'bed' END AS class, 0.25::DOUBLE + o_orderkey % 7 / 8.0::DOUBLE AS conf FROM orders),
s AS (SELECT k, class, spot, count(*) AS views FROM d WHERE conf > 0.3 GROUP BY ALL HAVING count(*) >= 2) SELECT k, CASE WHEN spot % 10 < 4 THEN 1 WHEN spot % 10 < 8 THEN 2 END AS room, class, count(*) AS objects, sum(views)::BIGINT AS views FROM s GROUP BY ALL"""
)
def plan_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in single frames, gathered to objects that were seen twice or more, by room: spots lie 2 m apart, detections of a spot within 12 cm."""
    k, spot = F.col("o_orderkey"), F.col("o_custkey") % 60
    kind = F.when(F.col("o_custkey") % 3 == 0, "toilet").when(F.col("o_custkey") % 3 == 1, "sink").otherwise("bed")
    d = table(spark, sf_dir, "orders").select((k % 5).alias("k"), (spot % 10 * 2 + k % 5 * 0.02 + 1).cast("double").alias("u"), (F.floor(spot / 10) * 2 + k % 3 * 0.03 + 1).cast("double").alias("v"), kind.alias("class"), (0.25 + k % 7 / 8).alias("conf"))
    rects = spark.range(5).select(F.col("id").alias("k"), F.explode(F.array(*[F.struct(F.lit(r).alias("room"), F.lit(a).alias("u0"), F.lit(b).alias("u1")) for r, a, b in ((1, 0.0, 8.0), (2, 8.0, 16.0))])).alias("_r")).select("k", "_r.*", F.lit(0.0).alias("v0"), F.lit(20.0).alias("v1"))
    return instances(d, rects, ["k"]).groupBy("k", "room", "class").agg(F.count("*").alias("objects"), F.sum("views").alias("views"))


@query(
    """WITH RECURSIVE t AS (SELECT c_nationkey AS k, c_custkey AS node, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS parent, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS c, CASE c_custkey % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS s, c_custkey * 7 % 11 - 5 AS x, c_custkey * 5 % 13 - 6 AS y FROM customer),
w AS (SELECT k, node, node AS root, c::BIGINT AS c, s::BIGINT AS s, x::BIGINT AS x, y::BIGINT AS y FROM t WHERE parent IS NULL UNION ALL SELECT t.k, t.node, w.root, w.c * t.c - w.s * t.s, w.s * t.c + w.c * t.s, w.c * t.x - w.s * t.y + w.x, w.s * t.x + w.c * t.y + w.y FROM w JOIN t ON t.k = w.k AND t.parent = w.node)
SELECT k, node, root, c, s, x, y FROM w"""
)
def composed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers as a chain of frames, each turned by quarters and shifted against the one before: where they all stand against the first."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    cos, sin = F.when(k % 4 == 0, 1.0).when(k % 4 == 2, -1.0).otherwise(0.0), F.when(k % 4 == 1, 1.0).when(k % 4 == 3, -1.0).otherwise(0.0)
    x, y, no, one = (k * 7 % 11 - 5).cast("double"), (k * 5 % 13 - 6).cast("double"), F.lit(0.0), F.lit(1.0)
    tree = c.select(F.col("c_nationkey").alias("k"), k.alias("node"), before.alias("parent"), F.array(cos, -sin, no, x, sin, cos, no, y, no, no, one, no).alias("m"))
    m = register.composed_poses(tree, ["k"])
    return m.select("k", "node", "root", *[F.col("m")[i].cast("long").alias(n) for i, n in ((0, "c"), (4, "s"), (3, "x"), (7, "y"))])
