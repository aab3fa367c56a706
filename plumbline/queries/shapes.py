"""Polygons of any shape over the tables: L-shaped rooms turned by different angles (one for each supplier), and hulls of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygons
from ..plans.known_room import POINTS_SQL, points_mm
from . import query, table

ROOMS_SQL = """s AS (SELECT s_suppkey AS room, (s_suppkey * 37 % 4000)::DOUBLE AS cu, (s_suppkey * 91 % 3000)::DOUBLE AS cv, (200 + s_suppkey % 5 * 100)::DOUBLE AS hu, (150 + s_suppkey % 3 * 100)::DOUBLE AS hv,
  CASE s_suppkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE -0.28::DOUBLE END AS c, CASE s_suppkey % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN -0.6::DOUBLE ELSE 0.96::DOUBLE END AS si FROM supplier),
l AS (SELECT room, cu, cv, c, si, unnest([{'i': 0, 'x': -hu, 'y': -hv}, {'i': 1, 'x': hu, 'y': -hv}, {'i': 2, 'x': hu, 'y': 0}, {'i': 3, 'x': 0, 'y': 0}, {'i': 4, 'x': 0, 'y': hv}, {'i': 5, 'x': -hu, 'y': hv}]) AS p FROM s),
w AS (SELECT room, p.i AS i, cu + (c * p.x - si * p.y) AS u, cv + (si * p.x + c * p.y) AS v FROM l),
e AS (SELECT a.room, a.u AS u0, a.v AS v0, b.u AS u1, b.v AS v1 FROM w a JOIN w b ON a.room = b.room AND b.i = (a.i + 1) % 6)"""


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room, polygon: L-shaped, turned by one of four angles, in millimetres."""
    k = F.col("s_suppkey")
    turn = lambda values: F.when(k % 4 == 0, values[0]).when(k % 4 == 1, values[1]).when(k % 4 == 2, values[2]).otherwise(values[3])
    d = table(spark, sf_dir, "supplier").select(k.alias("room"), (k * 37 % 4000).cast("double").alias("cu"), (k * 91 % 3000).cast("double").alias("cv"), (200 + k % 5 * 100).cast("double").alias("hu"), (150 + k % 3 * 100).cast("double").alias("hv"), turn([1.0, 0.6, 0.8, -0.28]).alias("c"), turn([0.0, 0.8, -0.6, 0.96]).alias("s"))
    hu, hv, zero, c, s = F.col("hu"), F.col("hv"), F.lit(0.0), F.col("c"), F.col("s")
    local = [(-hu, -hv), (hu, -hv), (hu, zero), (zero, zero), (zero, hv), (-hu, hv)]
    return d.select("room", F.array(*[F.array(F.col("cu") + (c * x - s * y), F.col("cv") + (s * x + c * y)) for x, y in local]).alias("polygon"))


@query(
    f"""WITH {POINTS_SQL}, {ROOMS_SQL}, p AS (SELECT row_number() OVER () AS rid, u_mm::DOUBLE AS u, v_mm::DOUBLE AS v, h_mm FROM points),
x AS (SELECT rid, any_value(h_mm) AS h_mm, room FROM p JOIN e ON (e.v0 > v) <> (e.v1 > v) AND u < (e.u1 - e.u0) * (v - e.v0) / (e.v1 - e.v0) + e.u0 GROUP BY rid, room HAVING count(*) % 2 = 1),
m AS (SELECT rid, any_value(h_mm) AS h_mm, min(room) AS room FROM x GROUP BY rid) SELECT room, count(*) AS n, sum(h_mm)::BIGINT AS h FROM m GROUP BY room"""
)
def points_in_turned_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's first room of those that hold it."""
    hit = polygons.points_in_polygons(points_mm(spark, sf_dir).select("u_mm", "v_mm", "h_mm"), rooms(spark, sf_dir), "u_mm", "v_mm", "room", "room", size=250)
    return hit.groupBy("room").agg(F.count("*").alias("n"), F.sum("h_mm").cast("long").alias("h"))


@query(
    f"""WITH {ROOMS_SQL}, b AS (SELECT room, floor(min(u0) / 50)::BIGINT - 1 AS c0, floor(max(u0) / 50)::BIGINT + 1 AS c1, floor(min(v0) / 50)::BIGINT - 1 AS r0, floor(max(v0) / 50)::BIGINT + 1 AS r1 FROM e GROUP BY room),
g AS (SELECT room, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM b)), p AS (SELECT *, (c + 0.5::DOUBLE) * 50 + 0.123::DOUBLE AS u, (r + 0.5::DOUBLE) * 50 + 0.077::DOUBLE AS v FROM g)
SELECT room, r, c FROM p JOIN e USING (room) WHERE (e.v0 > v) <> (e.v1 > v) AND u < (e.u1 - e.u0) * (v - e.v0) / (e.v1 - e.v0) + e.u0 GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def turned_room_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells whose centres the turned rooms hold."""
    return polygons.polygon_cells(rooms(spark, sf_dir), 50.0, ["room"], origin=(0.123, 0.077))


@query(
    """WITH p AS (SELECT DISTINCT c_nationkey AS k, (c_custkey * 37 % 1009)::DOUBLE AS u, (c_custkey * 91 % 757)::DOUBLE AS v FROM customer),
d AS (SELECT a.k, a.u AS u, a.v AS v, b.u - a.u AS du, b.v - a.v AS dv FROM p a JOIN p b ON a.k = b.k AND (a.u <> b.u OR a.v <> b.v)),
m AS (SELECT d.k, d.u, d.v, d.du, d.dv, min((p.v - d.v) * d.du - (p.u - d.u) * d.dv) AS below, max((p.v - d.v) * d.du - (p.u - d.u) * d.dv) AS above, max((p.u - d.u) * d.du + (p.v - d.v) * d.dv) - min((p.u - d.u) * d.du + (p.v - d.v) * d.dv) AS along FROM d JOIN p ON p.k = d.k GROUP BY ALL),
r AS (SELECT k, along * above / (du * du + dv * dv) AS area, greatest(along, above) / sqrt(du * du + dv * dv) AS l, least(along, above) / sqrt(du * du + dv * dv) AS s FROM m WHERE below >= 0)
SELECT k, round(min(area), 4) AS rect_area, round(arg_min(l, (round(area, 6), -l)), 4) AS long_side, round(arg_min(s, (round(area, 6), -l)), 4) AS short_side FROM r GROUP BY k"""
)
def smallest_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangle of least area round each nation's customers."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), (k * 37 % 1009).alias("u"), (k * 91 % 757).alias("v"))
    r = polygons.rotated_rectangles(polygons.hulls(p, ["k"], "u", "v"), ["k"])
    return r.select("k", *[F.round(c, 4).alias(c) for c in ("rect_area", "long_side", "short_side")])
